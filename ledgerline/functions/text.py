"""Text functions (X1, X2, X4) as Spark column expressions.

Whitespace follows Python's ``str.split()``: the Unicode white-space set
plus the ASCII separators 0x1C-0x1F.  Empty tokens (leading/trailing
blanks) are dropped, so no ``trim`` is needed before splitting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import blank_to_default, strip

# Chunking and retrieval settings of the reference.
CHUNK_SIZE_WORDS = 80
CHUNK_OVERLAP_WORDS = 10
MIN_CHUNK_SIZE_WORDS = 20
MAX_TEXT_CHARS = 1200
EMBED_BATCH_SIZE = 16
TOP_K = 3
MIN_SCORE = 0.35

# Python str.split() white space, as a Java regex.
WS_JAVA = "(?U)[\\s\\x1c-\\x1f]+"
# Same set for RE2 (DuckDB), whose \s is ASCII-only.
WS_RE2 = ("[\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}"
          "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col) -> Column:
    """Whitespace tokens of a text (empty array for null/blank)."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), WS_JAVA)
    return F.array_remove(parts, "")


def chunk_params(size: int = CHUNK_SIZE_WORDS, overlap: int = CHUNK_OVERLAP_WORDS):
    size = max(MIN_CHUNK_SIZE_WORDS, int(size))
    overlap = max(0, int(overlap))
    step = size - overlap if overlap < size else size
    return size, step


def chunk_text(col, size: int = CHUNK_SIZE_WORDS, overlap: int = CHUNK_OVERLAP_WORDS) -> Column:
    """Split a text into overlapping word windows (array<string>).

    Blank text -> no chunk; at most ``size`` words -> the original text as
    one chunk; otherwise windows of ``size`` words joined by one space,
    starting every ``step = size - overlap`` words (``size`` when the
    overlap is not smaller than the size), until a window reaches the end.
    The whole text is chunked; nothing is cut off.
    """
    size, step = chunk_params(size, overlap)
    text = _c(col)

    def per_text(w):
        # ``w`` is a lambda variable: the split runs once per text, not once
        # per chunk (an expression referenced inside a lambda is re-evaluated
        # on every call).
        n = F.size(w)
        n_chunks = F.lit(1) + F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")
        windows = F.transform(
            F.sequence(F.lit(0), n_chunks - 1),
            lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
        return (F.when(n == 0, F.array().cast("array<string>"))
                 .when(n <= size, F.array(text))
                 .otherwise(windows))

    return F.transform(F.array(words(text)), per_text)[0]


def prepare_text(col, max_chars: int | None = None) -> Column:
    """Collapse white space to single spaces, trim; whole texts unless
    ``max_chars`` is given (``MAX_TEXT_CHARS`` is the reference's limit of an
    embedding input)."""
    clean = F.array_join(words(col), " ")
    if max_chars is None:
        return clean
    return F.substring(clean, 1, int(max_chars))


def knowledge_text(product_id="product_id", product_name="product_name", category="category",
                   brand="brand", description="product_description",
                   return_policy="return_policy", faq_answer="faq_answer",
                   review="review", available: set[str] | None = None) -> Column:
    """The compact labelled knowledge text of one product.

    Four lines always (name defaults to the id), four more only when the
    value is non-blank; lines joined by a newline.  Columns not in
    ``available`` are treated as absent.
    """
    def val(name, default=""):
        if available is not None and name not in available:
            return F.lit(default) if default else F.lit(None).cast("string")
        v = blank_to_default(name, default)
        return v if default else F.nullif(v, F.lit(""))

    pid = val(product_id, "unknown")
    name = F.coalesce(val(product_name), pid) if (available is None or product_name in available) \
        else pid
    lines = [
        F.concat(F.lit("Product ID: "), pid),
        F.concat(F.lit("Product Name: "), name),
        F.concat(F.lit("Category: "), val(category, "general")),
        F.concat(F.lit("Brand: "), val(brand, "generic")),
        F.concat(F.lit("Description: "), val(description)),
        F.concat(F.lit("Return Policy: "), val(return_policy)),
        F.concat(F.lit("FAQ Answer: "), val(faq_answer)),
        F.concat(F.lit("Customer Review: "), val(review)),
    ]
    # concat with a null part is null, and concat_ws skips nulls
    return strip(F.concat_ws("\n", *lines))
