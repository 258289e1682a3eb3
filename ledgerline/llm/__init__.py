"""Training-data operators: search, de-duplication, filters, packing, models.

Every module holds one operator with its own general interface; ``queries``
derives the registered ``opN_<name>`` digests from them.  Nothing outside
this subpackage imports it (``__spark_entry__.py`` adds its queries only if
it is there).
"""
