"""Alignment, url filters and prefix trie against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from lumenads.llm import alignment, prefix_trie, url_filters
from lumenads.llm.components import components
from tests.compare import duck_rows, spark_rows
from tests.llm.data import ROWS, documents, empty, sample


# Alignment

def _spelled(pair, text):
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    same = b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b) == b" " + text.encode()
    return (a, b) if same else None


def _groups(pair, a, b):
    """Groups by walking the two lists of byte ends."""
    ends = []
    for side, ids in ((pair.a_bytes, a), (pair.b_bytes, b)):
        total, own = 0, []
        for i in ids:
            total += len(side[i])
            own.append(total)
        ends.append(own)
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, x, y = [], 0, 0
    for end in both:
        i, j = ends[0].index(end, x) + 1, ends[1].index(end, y) + 1
        groups.append((a[x:i], b[y:j]))
        x, y = i, j
    return groups


def _alignment_by_hand(rows):
    pair = alignment.pair_of(alignment.BYTE_LEVEL, alignment.PIECES)[0]
    docs, held = [], Counter()
    for doc_id, text in rows:
        ids = _spelled(pair, text)
        groups = _groups(pair, *ids) if ids else []
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        docs.append((doc_id, ids, groups, links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, ids, groups, links in docs:
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            doc_id, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), sum(links.values()),
            sum(n for x, n in links.items() if held[x] == most[x[0]]), sum(n * held[x] for x, n in links.items()),
            hashlib.sha256(shown.encode()).hexdigest() if ids else "",
        ))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (20, "a  b\n\n c \n", "en", "a"), (21, "x▁y", "en", "a"), (22, "tab\there\r\nthere", "en", "a"),
    (23, "<s> <unk> <0x41> <|endoftext|>", "en", "a"), (24, "ﬁ ａｂ 👩‍👩‍👧 naïve, naïve.", "en", "a"), (25, " lead", "en", "a"),
    (26, "\n", "en", "a"), (27, "don't can't, we'll!! ok;ok", "en", "b"), (28, "é a\x00b", "en", "b"),
]


@pytest.mark.parametrize("head", [alignment.HEAD_LINKS, 40, 0])
def test_alignment_is_brute_force(spark, head):
    rows = ROWS + ODD + [(100 + i, r.text, r.lang, r.source) for i, r in enumerate(sample(spark).limit(60).collect())]
    result = alignment.alignment(documents(spark, rows), head).select(*COLUMNS).collect()
    expected = _alignment_by_hand([(r[0], r[1]) for r in rows])
    assert sorted((tuple(r) for r in result), key=str) == expected
    assert sum(r.n_links for r in result) > 10_000


def test_alignment_of_no_rows(spark):
    assert alignment.alignment(empty(spark)).count() == 0


def test_alignment_forgets_windows(spark, monkeypatch):
    """Results do not depend on what is kept."""
    pair, windows = alignment.pair_of(alignment.BYTE_LEVEL, alignment.PIECES)
    texts = [r.text for r in sample(spark).limit(20).collect()]
    before = [alignment.aligned_text(pair, windows, t) for t in texts]
    monkeypatch.setattr(alignment, "KEPT_WORDS", 5)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 5)
    assert [alignment.aligned_text(pair, windows, t) for t in texts] == before


def test_alignment_forgets_words(monkeypatch):
    """A text keeps its tokens when the kept words are dropped while it is encoded."""
    monkeypatch.setattr(alignment, "KEPT_WORDS", 3)
    pair = alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES)
    texts = ["one two three", "one four", "two five one", "six one four", "one two three"]
    for text in texts:
        a, b = _spelled(pair, text)
        assert pair.ids(text) == (alignment.packed(a), alignment.packed(b))


@pytest.mark.parametrize("kept, at_once", [(300_000, 1 << 16), (3, 1 << 16), (3, 5)])
def test_alignment_of_texts_together(monkeypatch, kept, at_once):
    """New words of many texts go to the tokenizers at once; each text has what it has alone."""
    monkeypatch.setattr(alignment, "KEPT_WORDS", kept)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", at_once)
    monkeypatch.setattr(alignment, "NEW_WORDS", max(4, at_once >> 2))
    pair = alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES)
    library, calls = pair.b, []

    class Counted:
        def encode(self, *args, **options):
            calls.append(args)
            return library.encode(*args, **options)

    pair.b = Counted()
    plain = [f"some words{chr(97 + i)}word and nothing{chr(97 + i)}else, twice." for i in range(20)]
    windows = alignment.Windows(pair)
    found = list(alignment.aligned_texts(windows, plain))
    assert at_once == 5 or len(calls) == 1
    pair.b = library
    odd = [r[1] for r in ROWS + ODD if r[1] is None or len(r[1]) < 1000] + ["fine ﬁ", "fine", "x" * 200 + " y" * 200]
    found += alignment.aligned_texts(windows, odd)
    for text, row in zip(plain + odd, found, strict=True):
        if (ids := _spelled(pair, text)) is None:
            assert row == (0, 0, 0, 0, "", None)
            continue
        groups = _groups(pair, *ids)
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        links = Counter((a << 32) + b for g in groups for a in g[0] for b in g[1])
        assert row[:3] == (len(ids[0]), len(ids[1]), len(groups)) and row[3] == sum(links.values())
        assert row[4] == hashlib.sha256(shown.encode()).hexdigest()
        codes, times, _ = alignment.unpacked([row[5]])
        assert dict(zip(codes.tolist(), times.tolist())) == links


def test_alignment_of_one_long_text(spark):
    pair, windows = alignment.pair_of(alignment.BYTE_LEVEL, alignment.PIECES)
    text = " ".join(r.text for r in sample(spark).limit(100).collect() if r.text) * 10
    n_a, n_b, groups, links, _, packed = alignment.aligned_text(pair, windows, text)
    assert len(text) > 1_000_000 and groups <= min(n_a, n_b) and links >= groups
    assert alignment.unpacked([packed])[1].sum() == links


# Url filters

PAGE = "page_id long, url string, html string, node string, rule string, host string"
CASES = [
    (1, "https://a.example.net/x", '<link rel="canonical" href="http://b.com/de/1">', "block", None),
    (2, "http://B.com/de/1#f", None, "block", "com/de/"),
    (3, "http://c.net", '<META HTTP-EQUIV=refresh content="0; url=//a.example.net/x">', "block", None),
    (4, "http://d.net/q", '<!-- <link rel=canonical href="http://b.com/de/1"> -->', "allow", None),
    (5, "http://e.net/a/b?z", '<link href=/root rel="nofollow canonical">', "allow", None),
    (6, "http://e.net/root", "", "allow", None),
    (7, None, None, "allow", None),
    (8, "nourl", "<link rel=canonical href=http://b.com/de/9>", "allow", None),
    (9, "http://f.org/k", "<link rel=canonical href=http://g.net/1>", "allow", "org/"),
    (10, "http://g.net/1", "<link rel=canonical href='http://z.com/de/4'>", "allow", None),
    (11, "http://z.com/de/4", "", "block", "com/de/"),
    (12, "ftp://www.Example.ORG/es/1?x#y", "", "block", "example.org/es/"),
    (13, "http://example.org/en/15", "", "block", "example.org/en/1"),
    (14, "http://notexample.org/es/", "", "allow", "org/"),
    (15, "http://example.org", "", "allow", None),
    (16, "http://com/fr/", "", "allow", "com/fr/"),
    (None, "http://b.com/de/1", "", "block", "com/de/"),
    (None, "http://b.com/de/1", "", "block", "com/de/"),
    (17, "http://example.org:80/es/", "", "allow", None),
    (18, "http://h.net/a/b", "<link rel=canonical href=c>", "block", None),  # h.net/a/c is redirected to a block
    (19, "http://i.net/a", '<script>"<link rel=canonical href=http://b.com/de/1>"</script>', "allow", None),
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h, *_ in CASES], PAGE)
    redirects = spark.createDataFrame([("http://h.net/a/c", "http://b.com/de/7"), (None, "x")], "from_url string, to_url string")
    result = url_filters.judged(pages, redirects=redirects)
    got = sorted(((r.page_id, r.verdict, r.rule) for r in result.collect()), key=str)
    assert got == sorted(((i, v, r) for i, _, _, v, r in CASES), key=str)


def test_url_filters_match_sql(spark, tmp_path):
    """Components of many aliases, by the recursive SQL."""
    pages = []
    for i in range(300):
        host = ("a.example.net", "b.example.com", "c.example.org")[i % 3]
        to = f"https://{('a.example.net', 'b.example.com')[i % 2]}/{('en', 'de', 'fr')[(i // 7) % 3]}/{(i * 7) % 40}"
        html = f'<html><link rel="canonical" href="{to}"></html>' if i % 4 else "<html></html>"
        pages.append((i, f"http://{host}/{('en', 'de', 'es', 'fr')[i % 4]}/{i % 40}", html))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, wanted = spark_rows(url_filters.op12_url_filters(spark, str(tmp_path))), duck_rows(con, url_filters.OP12_SQL)
    assert got == wanted
    assert sum("str:block" in r for r in got[1]) > 50


def test_url_filters_without_pages_or_rules(spark):
    none = spark.createDataFrame([], PAGE)
    assert url_filters.judged(none).count() == 0
    pages = spark.createDataFrame([(1, "http://b.com/de/1", "", "", "", "")], PAGE)
    assert url_filters.judged(pages, ()).first().verdict == "allow"
    assert components(none.selectExpr("url a", "html b"), "a", "b").count() == 0


# Prefix trie

TURNS = "conv_id long, turn int, role string, text string, node string, depth long, key string, part long"


def _trie_by_hand(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in by_conv.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (
            (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        )
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), above, len(convs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _trie(spark, rows, fan=2, partitions=7):
    frame = spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], TURNS)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, fan).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_trie_is_brute_force_over_many_partitions(spark):
    rows = []
    for c in range(400):
        for t in range(c % 13):
            rows.append((c, t, ("user", "assistant")[t % 2], f"{'ü' * (c % 2)}{(c * t) % 3} {t}"))
    rows += [(c, None, None, None) for c in range(0, 60, 5)] + [(1000 + c, 0, "user", "same") for c in range(300)]
    rows += [(None, 0, "user", "no id"), (5000, 1, "user", "twice"), (5000, 1, "user", "twice"), (5000, 1, "bot", "twice")]
    rows += [(-7, t, "user", f"deep {t}") for t in range(300)] + [(-8, t, "user", f"deep {t}") for t in range(250)]
    assert _trie(spark, rows) == _trie_by_hand([r for r in rows])


def test_trie_of_copies_that_fill_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_A_ROW", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(12)]
    assert _trie(spark, rows, fan=3, partitions=11) == _trie_by_hand(rows)


def test_trie_edges(spark):
    assert _trie(spark, []) == []
    assert _trie(spark, [(None, 1, "a", "b")]) == []
    assert _trie(spark, [(1, 0, "a", "b")]) == _trie_by_hand([(1, 0, "a", "b")])
