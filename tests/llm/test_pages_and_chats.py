"""URL filters, WARC archives and preference chats against plain Python."""

from __future__ import annotations

import gzip
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import chat, url_filters, warc

PAGES = "page_id long, url string, html string, host string, path string, filter int, `_url` int, token int, page int"
MORE = ("h", "p", 1, 2, 3, 4)
URLS = [
    "http://a.b.example.net/en/1", "https://example.net/", "https://example.net", "http://EXAMPLE.NET/EN/1", "http://x.net/fr/", "http://net/x",
    "http://xnet/en/", "https://m.example.com/de/9?x=1", "https://example.com/deutsch", "https://www.w.org/fr/2#top", "http://org/fr/",
    "https://www.cheap-pills.example.org/en/3", "http://cheapxpills.org/a", "http://free-bets.example.com/de/", "no address", "", None,
    "ftp://u@spam-farm.org:80/fr/x", "mailto:a@b.net", "x://y?z://w.net/", "http://casino.example.org/fr/1", "http://mycasino.org/",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    found = None
    for name, verdict in (("net/", "block"), ("org/fr/", "allow"), ("example.net/en/", "allow"), ("example.com/de/", "block")):
        own, _, tail = name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            found = (name, verdict) if found is None or len(name) > len(found[0]) else found
    if found:
        return host, path, found[0], found[1]
    words = [w for w in ("casino", "cheap-pills", "free-bets", "porn", "spam-farm", "xxx") if re.search(f"(^|[^a-z0-9]){w.replace('-', '[^a-z0-9]')}([^a-z0-9]|$)", host)]
    return host, path, None, "block" if words else "allow"


def test_url_filter(spark):
    rows = [(i, u, None, *MORE) for i, u in enumerate(URLS)] + [(0, URLS[0], None, *MORE), (None, URLS[3], None, *MORE)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    out = url_filters.judged(pages)
    assert out.columns == [*pages.columns, "_filter"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r[9].host, r[9].path, r[9].rule, r[9].verdict) == plain_verdict(r.url), r.url


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("net",)] * 9 + [("example",)] * 5 + [("en",)] * 7, "token string")
    rules = [url_filters.host_rule("allow", "example.net/en/"), url_filters.host_rule("block", "rare.example.net/e"), url_filters.Rule("all", "block", ".*", (), 0)]
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.tokens), r.priority) for i, r in enumerate(rules)],
        "rule_id int, name string, verdict string, pattern string, tokens array<string>, priority int",
    )
    index = {r.name: r.token for r in url_filters.rule_index(tokens, table).collect()}
    assert index == {"example.net/en/": "example", "rare.example.net/e": "rare", "all": None}
    pages = spark.createDataFrame([(1, "http://a/b"), (2, None)], "page_id long, url string")
    assert {r[0]: r.filter.matched for r in url_filters.judged(pages, rules=rules).collect()}[1] == "all"


def test_segments_and_chunks():
    text = "añ字😀" * 500
    for size in (5, 7, 100, 10_000):
        parts = warc.segments(text, size)
        assert "".join(parts) == text and all(0 < len(p.encode()) <= size for p in parts)
        assert warc.unchunked(warc.chunked(text, size).encode()) == text.encode()
    assert warc.segments("", 9) == [""] and warc.unchunked(warc.chunked("").encode()) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


HTML = [
    (3, "http://a/x y\r\n", "same"), (1, None, "same"), (2, "u", "same"), (4, "u", ""), (5, "u", None), (6, "u", "é字😀" * 9000), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"),
    (8, "http://ü/", "x" * 70_000), (None, "u", "same"), (None, "u", "alone"), (9, "u", "é字😀" * 9000), (1, None, "same"), (10, "u", "\r\n0\r\n\r\n"),
]


@pytest.mark.parametrize("segment_bytes,min_bytes", [(warc.SEGMENT_BYTES, 0), (300, 5)])
def test_archives(spark, tmp_path, monkeypatch, segment_bytes, min_bytes):
    """What is read back is what was written, whatever the segments; files hold few records."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    pages = spark.createDataFrame([(i, u, h, *MORE) for i, u, h in HTML], PAGES).repartition(2)
    path = str(tmp_path / "warc")
    warc.write_pages(pages, path, min_bytes=min_bytes, segment_bytes=segment_bytes)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, r.payload and bytes(r.payload)) for r in warc.read_pages(spark, path).collect())
    want = []
    for i, _, html in HTML:
        payload = (html or "").encode()
        firsts = [j for j, _, h in HTML if (h or "") == (html or "") and j is not None]
        first = i if len(payload) < min_bytes or not firsts or min(firsts) == i else min(firsts)
        again = first != i
        want.append((i or 0, len(payload), warc.payload_digest(payload), "revisit" if again else "response", first if again else 0, None if again else payload))
    assert got == sorted(want, key=lambda w: w[:5]) or sorted(map(repr, got)) == sorted(map(repr, want))


def test_archives_are_warc(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id long, url string, html string"), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Type: continuation") == 3 and data.count(b"WARC-Segment-Total-Length: ") == 1


def test_lost_segment_is_noticed(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([(1, "u", "y" * 50_000)], "page_id long, url string, html string"), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("part-*"))
    data = gzip.decompress(file.read_bytes())
    at = data.index(b"WARC/1.1", data.index(b"WARC-Segment-Number: 1"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.gz").write_bytes(gzip.compress(data[:at]))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_pages(spark, str(tmp_path / "cut")).collect()


TURNS = "conv_id long, turn long, role string, text string, pair_id int, chosen int, part string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS).repartition(3)


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "b"), (1, 0, "user", "hi"), (1, 1, "assistant", "c"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (4, 1, "assistant", "x"), (5, 0, None, ""), (5, 1, "assistant", "x"),
        (6, None, "system", "s"), (6, 0, "user", "q"), (6, 0, "user", "q"), (7, None, "system", "s"), (7, 0, "user", "q"), (9, 0, "assistant", "only"), (None, 0, "user", "lost"),
    ]
    got = {(r.pair_id, r.part, r.turn, r.text, r.copies, r.trained) for r in chat.preference_segments(chat.neighbours(conversations(spark, rows))).collect()}
    assert got == {
        (0, "prompt", 0, "hi", 1, False), (0, "chosen", 1, "a", 1, True), (0, "chosen", 2, "b", 1, False), (0, "rejected", 1, "c", 1, True),
        (1, "prompt", 0, "same", 1, False),
        (2, "chosen", 0, None, 1, False), (2, "rejected", 0, "", 1, False), (2, "chosen", 1, "x", 1, True), (2, "rejected", 1, "x", 1, True),
        (3, "prompt", None, "s", 1, False), (3, "chosen", 0, "q", 2, False), (3, "rejected", 0, "q", 1, False), (4, "rejected", 0, "only", 1, True),
    }


def shown(role, text):
    return f"<|{role or 'user'}|>\n{text or ''}<|end|>\n"


PAIRED = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "b"), (0, 3, "assistant", "é😀"), (1, 0, "user", "hi"), (1, 1, "assistant", "c"),
    (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "more"), (5, 0, "assistant", "only"),
    (6, None, "system", "s"), (6, 0, "assistant", "q"), (6, 0, "assistant", "q"), (7, None, "system", "s"), (7, 0, "assistant", "q"), (None, 0, "user", "lost"),
]


def test_preference_rows(spark):
    pairs = chat.neighbours(conversations(spark, PAIRED))
    got = {r.pair_id: r for r in chat.preference_pairs(pairs).collect()}
    first = got[0]
    assert (first.form, first.sides, first.prompt) == ("pair", "both", shown("user", "hi"))
    assert first.chosen == shown("assistant", "a") + shown("user", "b") + shown("assistant", "é😀")
    trained = [first.chosen[s.start : s.start + s.length] for s in first.chosen_spans]
    assert trained == [shown("assistant", "a"), shown("assistant", "é😀")]
    assert first.rejected == shown("assistant", "c") and [tuple(s) for s in first.rejected_spans] == [(0, len(first.rejected))]
    assert (got[1].sides, got[1].chosen, got[1].chosen_spans, got[1].rejected) == ("both", "", [], shown("assistant", "more"))
    assert (got[2].sides, got[2].prompt, got[2].chosen) == ("rejected", "", "")
    assert got[3].prompt == shown("system", "s") and got[3].chosen == 2 * shown("assistant", "q") and got[3].rejected == shown("assistant", "q")
    assert set(got) == {0, 1, 2, 3}


@pytest.mark.parametrize("bound", [{"max_chars": 60}, {"max_segments": 3}])
def test_pairs_beyond_the_bounds_stay_segments(spark, bound):
    pairs = chat.neighbours(conversations(spark, PAIRED))
    rows = chat.preference_pairs(pairs, **bound).collect()
    loose = sorted((r for r in rows if r.form == "segment" and r.pair_id == 0), key=lambda r: r.turn)
    assert [(r.turn, r.prompt, r.chosen, r.rejected) for r in loose if not r.rejected] == [
        (0, shown("user", "hi"), None, None), (1, None, shown("assistant", "a"), None),
        (2, None, shown("user", "b"), None), (3, None, shown("assistant", "é😀"), None),
    ]
    assert {r.sides for r in loose} == {"both"}
    assert [r.chosen_spans and [tuple(s) for s in r.chosen_spans] for r in loose if r.chosen] == [[(0, len(shown("assistant", "a")))], [], [(0, len(shown("assistant", "é😀")))]]
    assert all(r.form == "pair" for r in rows if r.pair_id in (1, 2))


def test_cut_answers(spark):
    pairs = chat.cut_answers(conversations(spark, PAIRED + [(20, 0, "user", "no answer"), (21, 0, "assistant", None)]))
    got = {r.pair_id: r for r in chat.preference_pairs(pairs).collect()}
    assert got[-1].prompt == shown("user", "hi") + shown("assistant", "a") + shown("user", "b")
    assert (got[-1].chosen, got[-1].rejected) == (shown("assistant", "é😀"), shown("assistant", "é"))
    assert got[-21].prompt == shown("user", "no answer") and got[-21].chosen == got[-21].rejected == ""
    assert got[-22].prompt == shown("assistant", None)
    assert got[-7].rejected == 2 * shown("assistant", "")
    assert chat.preference_pairs(chat.cut_answers(spark.createDataFrame([], TURNS))).count() == 0


def test_rendered_turns(spark):
    rows = [(0, 0, None, None), (0, 1, "assistant", "é" * 100_000), (1, 0, None, None)]
    got = {r.turn: r for r in chat.preference_segments(chat.neighbours(conversations(spark, rows))).collect()}
    assert got[0].rendered == "<|user|>\n<|end|>\n" and got[0].part == "prompt"
    assert got[1].n_chars == 100_000 + len("<|assistant|>\n<|end|>\n")


def test_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    assert url_filters.judged(pages).count() == 0
    warc.write_pages(pages, str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0
    assert chat.preference_segments(chat.neighbours(spark.createDataFrame([], TURNS))).count() == 0


def test_long_pairs_are_rows_like_others(spark):
    """The form of a pair does not depend on its length, in characters or in turns."""
    long = [(0, 0, "user", "q" * 1_100_000), (0, 1, "assistant", "a"), (1, 0, "user", "q" * 1_100_000), (1, 1, "assistant", "b")]
    many = [(c, t, "user", "t") for c in (2, 3) for t in range(10_100)] + [(2, 10_100, "assistant", "c")]
    got = {r.pair_id: r for r in chat.preference_pairs(chat.neighbours(conversations(spark, long + many))).collect()}
    assert [got[k].form for k in sorted(got)] == ["pair", "pair"]
    assert got[0].prompt == "<|user|>\n" + "q" * 1_100_000 + "<|end|>\n" and got[0].rejected == "<|assistant|>\nb<|end|>\n"
    assert got[1].prompt == "<|user|>\nt<|end|>\n" * 10_100 and got[1].chosen == "<|assistant|>\nc<|end|>\n"
