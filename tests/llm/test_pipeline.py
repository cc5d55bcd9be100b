"""Registered queries against their SQL, and the pipeline against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import md5
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from ledgerlark.llm import quality
from ledgerlark.llm.oracle import ORACLE
from ledgerlark.llm.queries import QUERIES

from .conftest import prose, words
from .test_documents import groups, tokens
from .test_text_output import library

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["op1_source_mix", "op5_quality_rules", "op7_preference_chat"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def corpus():
    common = " the cat and the dog in a house of stone "
    docs = [(i, prose(i, 60) + common + prose(1000 + i, 50)) for i in range(40)]
    docs += [(40 + i, docs[i][1]) for i in range(5)]  # copies
    docs += [(50 + i, docs[10 + i][1].replace("house", "barn")) for i in range(5)]  # near copies
    docs += [(60 + i, " ".join(f"{w}%%%&&&" for w in words(60 + i, 120))) for i in range(4)]  # symbols
    docs += [(70 + i, " ".join(["one two three"] * 40)) for i in range(3)] + [(75, None), (76, ""), (77, "too short")]
    items = [(i, prose(3000 + i, 20)) for i in range(6)]
    docs += [(80 + i, prose(80 + i, 50) + common + items[i % 6][1] + " " + prose(1080 + i, 40)) for i in range(8)]
    rows = [(i, t, "en" if i % 4 else None, None if i % 7 == 0 else f"s{i % 3}", None) for i, t in docs]
    return rows, items


def histogram_distance(own, other):
    own, other = ([x / sum(h) for x in h] for h in (own, other))
    entropy = lambda h: -sum(p * math.log2(p) for p in h if p)
    return math.sqrt(max(0, entropy([(a + b) / 2 for a, b in zip(own, other)]) - (entropy(own) + entropy(other)) / 2))


def judged(rows):
    """Ids that the quality rules keep."""
    lists = {**quality.COMMON_WORDS, "*": sorted({w for ws in quality.COMMON_WORDS.values() for w in ws})}
    histograms, sums = {}, {}
    for i, text, lang, _, _ in rows:
        key, left, chars = lang if lang in quality.COMMON_WORDS else "*", text or "", []
        for pattern in quality.CHAR_CLASSES:
            rest = re.sub(pattern, "", left)
            chars.append(len(left) - len(rest))
            left = rest
        often = Counter(w.lower() for w in tokens(text))
        common = [often[w] for w in lists[key]]
        histograms[i] = key, [*chars, len(left)], [*common, len(tokens(text)) - sum(common)]
        for kind in (1, 2):
            old = sums.get((key, kind), [0] * len(histograms[i][kind]))
            sums[key, kind] = [a + b for a, b in zip(old, histograms[i][kind])]
    kept = set()
    for i, text, _, _, _ in rows:
        own, key = tokens(text), histograms[i][0]
        triples = [tuple(own[j : j + 3]) for j in range(len(own) - 2)]
        often = Counter(triples)
        repeated = len({j + d for j, t in enumerate(triples) if often[t] > 1 for d in range(3)})
        if len(own) < 50 or 100 * repeated > 50 * len(own):
            continue
        far = len(text) >= quality.MIN_CHARS and histogram_distance(histograms[i][1], sums[key, 1]) > quality.MAX_CHAR_DISTANCE
        far |= len(own) >= quality.MIN_WORDS and histogram_distance(histograms[i][2], sums[key, 2]) > quality.MAX_WORD_DISTANCE + quality.WORD_NOISE / len(own) ** 0.5
        if not far:
            kept.add(i)
    return kept


def mix(rows):
    """How often each id is taken."""
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(tokens(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(3 * sizes[s] for s in order if s not in open_)
        target = {s: rest * weight[s] / sum(weight[t] for t in open_) if s in open_ else 3 * sizes[s] for s in order}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    taken = Counter()
    for i, _, _, source, _ in rows:
        rate = target[source] / sizes[source]
        draw = int(md5(f"{i}:mix-1".encode()).hexdigest()[:13], 16) / 2**52
        taken[i] = int(rate) + (draw < rate - int(rate))
    return taken


def test_stages(spark, tmp_path):
    rows, items = corpus()
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "token_output":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        done[name] = Counter(r.doc_id for r in docs.collect())
    by_id = {r[0]: r for r in rows}
    kept = judged(rows)
    assert done["quality_rules"] == Counter(kept) and not kept & set(range(60, 78)) and set(range(40)) <= kept
    found = groups([(i, by_id[i][1]) for i in kept])
    first = {i for (i, _), (_, head) in found.items() if i == head}
    assert done["near_duplicates"] == Counter(first) and first == kept - set(range(40, 60))
    clean = {i for i in first if not any(t in by_id[i][1] for _, t in items)}
    assert done["benchmark_leaks"] == Counter(clean) and clean == first - set(range(80, 88))
    taken = mix([by_id[i] for i in sorted(clean)])
    assert done["source_mix"] == +taken
    at = 0
    for r in docs.orderBy("start").collect():
        ids = library(by_id[r.doc_id][1])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in docs.select(*again.columns).collect())


def test_stages_take_empty_tables(spark, tmp_path):
    sf_dir = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
