"""Searches, joins and filters against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import jaccard_join, multiprobe, norm_search, suffix_dedup, url_filter
from ledgerline.llm.bitmaps import among, bitmap_of
from ledgerline.llm.components import components


def find_roots(edges):
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    got = components(spark.createDataFrame([*edges, (5, 5), (None, 7), edges[0]], "a long, b long"))
    want = {k: v for k, v in find_roots([(a, b) for a, b in edges if a != b]).items()}
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_hold_every_key(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("h"))
    bits = bitmap_of(keys, "h", bits=16)
    inside = np.array([r.h for r in keys.collect()], np.int64)
    other = np.array([r.h for r in spark.range(500, 3000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert among(bits, inside).all() and among(bits, other).mean() < 0.05


def vectors(spark, n=600, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.uniform(0.2, 2.0, size=(n, 1))
    x[50:80] = x[50]  # copies
    x[7] = 0.0
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    odd = [(None, [1.0] * dims), (9001, None), (9002, []), (9003, [float("nan")] * dims), (9004, [float("inf")] + [0.0] * (dims - 1)),
           (9005, [None] + [1.0] * (dims - 1)), (9006, [1.0] * (dims + 1)), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score double")
    return df, np.array([v for _, v in rows], np.float64)


@pytest.mark.parametrize("options", [{}, {"block_rows": 90, "query_rows": 10, "seed_rows": 20, "chunk": 16, "steps": (2, 5)}])
def test_norm_search_is_exact(spark, options):
    df, x = vectors(spark)
    got = [tuple(r) for r in norm_search.search(df, F.col("vec_id") % 20 == 0, k=5, scale=64, **options).orderBy("query_id", "rank").collect()]
    y = np.floor(x * 64).astype(np.int64)
    want = []
    for q in range(0, len(y), 20):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == want
    assert norm_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_topk(x, scale, every, k):
    y = np.floor(x * scale).astype(np.int64)
    want = []
    for q in range(0, len(y), every):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:k]
        want += [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]
    return want


@pytest.mark.parametrize("max_bands", [7, 5000])
def test_norm_search_with_two_thousand_blocks(spark, max_bands):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 6)) * rng.uniform(0.05, 3.0, size=(2000, 1))
    x[100:400] = x[100]  # one length shared by many rows: a band of many blocks
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = norm_search.search(df, F.col("vec_id") % 250 == 0, k=4, scale=64, block_rows=1, seed_rows=32, max_bands=max_bands)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == brute_topk(x, 64, 250, 4)


def test_bands_cut_the_blocks_that_cannot_reach():
    bands = norm_search.Bands(np.array([1.0, 2.0]), np.array([5.0, 1.9, 0.9]), np.array([0, 2, 3, 7]))
    assert bands.band(np.array([0.5, 1.0, 1.9, 2.0, 5.0])).tolist() == [2, 1, 1, 0, 0]
    assert sorted(set(bands.block(np.full(40, 0.5), np.arange(-20, 20)).tolist())) == [3, 4, 5, 6]
    assert bands.reach(np.array([1.0, 1.0, 1.0, 1.0, 0.0]), np.array([4.0, 1.9, 0.1, 6.0, 0.0])).tolist() == [2, 3, 7, 0, 7]


def test_multiprobe_recall_ranks_and_ties(spark):
    df, x = vectors(spark, n=1000)
    got = defaultdict(list)
    for r in multiprobe.search(df, F.col("vec_id") % 20 == 0, k=10, block_rows=300, query_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i not in (q, 7)][:10]
        hits += len({v for _, v, _ in got[q]} & set(order))
        total += 10
        assert [r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1))
        assert all(score == pytest.approx(s[v], abs=1e-9) for _, v, score in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[2], r[1]))
    assert hits >= 0.9 * total
    assert multiprobe.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_probe_template_is_ordered_and_valid():
    sets = multiprobe.probe_template(4, 60)
    assert sets[0] == () and len(set(sets)) == len(sets) == 60
    assert all(7 - r not in s for s in sets for r in s)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_url_rules_and_alias_decisions(spark):
    pages = [(1, "http://a.org/x", '<link rel="canonical" href="https://z.example.com/en/q">'), (2, "https://a.org/x/#t", None),
             (3, "http://b.org/", '<META http-equiv=refresh content="0; URL=/y">'),
             (4, "http://b.org/y", "<link href='http://www.example.com/en/1' rel=canonical>"), (5, None, None), (6, "http://c.org/p", ""),
             (7, "nourl/es/", "x"), (8, "https://www.c.org/p?utm_source=1&id=3", "<link rel=canonical href=http://q.net/fr/a>"),
             (9, "http://c.org/p?id=3", None), (1, "http://a.org/x", ""), (10, "HTTP://X.Example.COM", None),
             (11, "http://xexample.com/en/", None), (12, "s://a.NET/es/?x", None), (13, "s://net#/es/", None)]
    df = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.decide(df, rules).collect()}
    assert got[1] == ("a.org", "/x", None, "block") and got[2][3] == "block"
    assert got[3][3] == got[4][3] == "allow"
    assert got[5] == got[7] == ("", "", None, "allow")
    assert got[8][3] == got[9][3] == "block" and got[6][3] == "allow"
    assert got[10] == ("x.example.com", "", None, "allow")
    assert got[11] == ("xexample.com", "/en/", "com/", "allow")
    assert got[12] == ("a.net", "/es/", "net/es/", "block")
    assert got[13] == ("net", "", None, "allow")
    assert url_filter.decide(df.limit(0), rules).count() == 0
    assert url_filter.decide(df, rules.limit(0)).where("verdict = 'allow'").count() == len(pages)


class Links(HTMLParser):
    """The links of a page's head, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.stopped, self.hidden = {}, False, 0

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        self.stopped |= tag == "body"
        self.hidden += tag in ("template", "noscript")
        if self.stopped or self.hidden:
            return
        if tag == "link" and "canonical" in at.get("rel", "").lower().split():
            self.found.setdefault("canonical", at.get("href", ""))
        if tag == "meta" and at.get("property", "").lower() == "og:url":
            self.found.setdefault("og", at.get("content", ""))
        if tag == "meta" and at.get("http-equiv", "").lower() == "refresh":
            _, _, url = at.get("content", "").partition("=")
            self.found.setdefault("refresh", url)

    def handle_endtag(self, tag):
        self.stopped |= tag == "head"
        self.hidden -= tag in ("template", "noscript")


def brute_urls(pages, rules):
    """Verdicts by plain loops: every rule, urljoin, union-find."""
    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
        return (m.group(1).lower(), m.group(2), m.group(3) or "") if m else ("", "", "")

    def place(url):
        host, path, query = parts(url)
        host = re.sub(r"^www\.", "", re.sub(":(80|443)$", "", host))
        pairs = [p for p in query[1:].split("&") if not re.match("(utm_[a-z]+|ref|fbclid|gclid)=", p)]
        return (host, re.sub(r"/(index\.html?)?$", "", path), "&".join(pairs))

    def rule(url):
        host, path, _ = parts(url)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]), default=None)

    edges, urls = [], {}
    for _, url, html in pages:
        if url and "://" in url:
            edges.append((("form", url), ("place", place(url))))
            urls[("form", url)] = url
            links = Links()
            links.feed(html or "")
            for target in links.found.values():
                if target and not re.match("(mailto|javascript):", target):
                    full = urljoin(url, target.strip())
                    edges.append((("place", place(url)), ("place", place(full))))
                    edges.append((("form", full), ("place", place(full))))
                    urls[("form", full)] = full
    root, votes = find_roots(edges), defaultdict(set)
    for node, url in urls.items():
        if rule(url):
            votes[root[node]].add(rule(url)[2])
    out = []
    for page_id, url, _ in pages:
        r = rule(url)
        group = votes[root[("form", url)]] if url and "://" in url else set()
        out.append((page_id, r and r[0] + r[1], r[2] if r else "block" if group == {"block"} else "allow"))
    return sorted(out)


def test_url_filter_matches_plain_loops(spark):
    rng = random.Random(11)
    hosts = ["a.org", "www.a.org", "b.org", "x.example.com", "www.example.com", "q.net", *(f"h{i}.io" for i in range(30))]
    folders = ["/en/", "/es/", "/fr/", "/", "/x/y/", "/z/"]
    def url():
        tail = rng.choice(["", "", "?id=1", "?utm_source=m&id=1", "#top"])
        return f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(folders)}{rng.choice('pqrst')}{tail}"
    def reference():
        return rng.choice([url, lambda: "../" + rng.choice(["en/p", "es/q", "../fr/r", "./x/../z/s"]), lambda: "/fr/../es/" + rng.choice("pq"),
                           lambda: "//" + rng.choice(hosts) + "/es/p", lambda: "?id=1", lambda: "#end", lambda: "q", lambda: ".", lambda: "..",
                           lambda: "mailto:a@b.org", lambda: "/go?u=http://q.net/fr/p", lambda: "p?id=1&amp;ref=3"])()
    def page():
        link = rng.choice([f'<link rel="canonical" href="{reference()}">', f"<LINK HREF='{reference()}' REL='alternate canonical'/>",
                           f'<meta property="og:url" content="{reference()}">', f'<meta http-equiv="refresh" content="0; url={reference()}">',
                           f'<link rel="stylesheet" href="{reference()}">', f'<link data-rel="canonical" href="{reference()}">'])
        shape = rng.choice(["<html><head>%s</head><body>t</body></html>", "%s", "<head><!-- %s --></head>", "<script>var a = '%s';</script>",
                            "<head></head><body>%s</body>", "<head><style>p{}</style>%s<title>a</title></head>", "<template>%s</template>", ""])
        return shape % link if "%s" in shape else None
    pages = [(i, url(), page()) for i in range(900)] + [(900, None, "<link rel=canonical href=/es/p>"), (901, "no url", None), (902, "", "")]
    pages += [(1000 + i, f"http://s{i}.io/a/{i}", f"<head><link rel=canonical href='{'http://q.net/fr/./u' if i % 2 else '//x.net/es/../fr/u'}{i}'></head>")
              for i in range(20)]
    pages += [(7, url(), page()), pages[9]]  # one id with two URLs, one row twice
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.decide(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    want = brute_urls(pages, RULES)
    key = lambda r: tuple(str(c) for c in r)
    assert sorted(((r.page_id, r.rule, r.verdict) for r in got), key=key) == sorted(want, key=key)
    inherited = [r for r in want if r[1] is None and r[2] == "block"]
    assert len(inherited) > 10


@pytest.mark.parametrize("base,href,want", [
    ("http://h.org/a/b/c", "../z", "http://h.org/a/z"), ("http://h.org/a/b", "./", "http://h.org/a/"),
    ("http://h.org", "q", "http://h.org/q"), ("http://h.org/a?x=1", "#t", "http://h.org/a?x=1#t"),
    ("http://h.org/a?x=1", "?y", "http://h.org/a?y"), ("http://h.org/a/b", "../../../z", "http://h.org/z"),
    ("https://h.org/a", "//o.net/x/../y", "https://o.net/y"), ("http://h.org/a", "/r?u=http://q.net/", "http://h.org/r?u=http://q.net/"),
    ("http://h.org/a", "mailto:x@y", None)])
def test_references_are_resolved(spark, base, href, want):
    got = spark.createDataFrame([(base, href)], "b string, h string").select(url_filter.absolute(F.col("b"), F.col("h"))).first()[0]
    assert got == want


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_copies(seed=3, families=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(150)]
    shared = [rng.choice(words) for _ in range(12)]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))] + shared
        for _ in range(rng.randint(1, 9)):
            one = list(base)
            for _ in range(rng.randint(0, 3)):
                one[rng.randrange(len(one))] = rng.choice(words)
            out.append(" ".join(one) if rng.random() < 0.8 else "\t".join(one).upper())
    return out + ["", None, " \n", "one two", "ONE two", "one", "one two three four", "one two three four five"]


@pytest.mark.parametrize("width,ratio,options", [(4, (85, 100), {}), (5, (4, 5), {"block_shingles": 60, "group_size": 2}),
                                                 (2, (1, 2), {"block_shingles": 150, "group_size": 3})])
def test_jaccard_join_matches_all_pairs(spark, width, ratio, options):
    texts = near_copies()
    rows = [(i + 10, t, 7) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[0], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = jaccard_join.join(df, width=width, threshold=ratio, **options).collect()
    sets = {i + 10: shingle_set(t, width) for i, t in enumerate(texts)}
    num, den = ratio
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = find_roots(edges)
    want = sorted([(i, len(s), root.get(i, i)) for i, s in sets.items()] + [(14, len(sets[14]), root.get(14, 14))])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(len(sets[10]), None)]
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_large_clusters_are_dealt_on_both_sides_without_unlinked_template_pages(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    template = rng.integers(0, 1 << 63, 60, np.int64).view(np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 1 << 63, 40, np.int64).view(np.uint64)])) for _ in range(80)]
    sets[79] = np.unique(np.concatenate([sets[78][:97], rng.integers(0, 1 << 63, 3, np.int64).view(np.uint64)]))
    members = spark.createDataFrame([(7, i % 4, 4, i, bytearray(one.tobytes())) for i, one in enumerate(sets)],
                                    "cluster long, block int, blocks int, node long, set binary")
    may = jaccard_join._may_link(members, 8000, (85, 100))
    assert sorted(r.node for r in may.collect()) == [78, 79]
    labelled = members.select("cluster", "block", "blocks", "node", F.col("node").alias("label"),
                              F.octet_length("set").alias("bytes"), F.lit(True).alias("ask"))
    visits = jaccard_join._visits(labelled, 1000).select("cluster", "node", F.inline("visits"))
    asked, items = visits.where("ask"), visits.where("not ask")
    queries = asked.groupBy("cluster", "part", "block").count().collect()
    assert len(queries) == 8 * 4 and max(r["count"] for r in queries) < 40 and sum(r["count"] for r in queries) == 80 * 4
    assert {(r.part, r.block, r["count"]) for r in items.groupBy("part", "block").count().collect()} == {
        (p, b, 20) for p in range(8) for b in range(4)}


def brute_dedup(docs, length):
    count = Counter(b[i:i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for d, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,options", [(12, 4, {}), (30, 8, {"group_bytes": 200, "task_bytes": 300}), (12, 12, {"group_bytes": 100})])
def test_suffix_dedup_matches_brute_force(spark, length, gram, options):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 200)))) for i in range(40)]
    docs += [(60, docs[0][1]), (61, docs[1][1] + "x" + docs[2][1]), (62, None), (63, ""), (64, "a" * 300), (65, "ab" * 100),
             (66, "zz" + "ab" * 60), (5, docs[5][1]), (None, docs[7][1]), (67, "\0" * 40 + "q" + "\0" * 20)]
    p = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs += [(100 + i, "".join(rng.choice("abcdefgh") for _ in range(50)) + p + "".join(rng.choice("abcdefgh") for _ in range(50)))
             for i in range(30)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int")
    got = suffix_dedup.dedup(df, min_length=length, gram=gram, with_text=True, **options).collect()
    rows = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str)
    assert rows == brute_dedup([(d, (t or "").encode()) for d, t in docs], length)
    assert all(len(r.text.encode()) >= r.n_bytes - r.n_removed for r in got)
    assert suffix_dedup.dedup(df.limit(0), min_length=length).count() == 0


def test_repeated_starts_on_one_block():
    rng = random.Random(9)
    regions = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(8, 40))) for _ in range(25)]
    count = Counter(r[i:i + 8] for r in regions for i in range(len(r) - 7))
    for region, places in zip(regions, suffix_dedup.repeated_starts(regions, 8)):
        assert places.tolist() == [i for i in range(len(region) - 7) if count[region[i:i + 8]] > 1]
