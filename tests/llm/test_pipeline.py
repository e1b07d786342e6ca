"""The pipeline against a brute-force version of its stages."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from agrolith.llm import language_id, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_what_a_plain_version_keeps(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], sf)
        if i < 4:
            assert out.columns == docs.columns
        kept.append(out.cache())
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    lettered = {i for i in ids[0] if any(c.isalpha() for c in documents[i] or "")}
    assert ids[1] == lettered
    last = {}
    for i in sorted(lettered):
        last[documents[i]] = i
    assert ids[2] == set(last.values())

    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i in ids[2] for w in [documents[i].encode().lower().split()]}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= corpus_pipeline.NEAR_PERCENT * len(sets[i] | sets[j])]
    for _ in range(10):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert ids[3] == {i for i in sets if label[i] == i}
    n = {i: len(documents[i].split()) for i in ids[3]}
    assert ids[5] == ids[4] and all(r.round_trip for r in kept[5].select("round_trip").collect())
    # the language told stands in the rows that the mix takes
    told = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert {r.doc_id: r.lang for r in kept[1].select("doc_id", "lang").collect()} == {i: told[i] for i in lettered}
    assert ids[4] == _mixed({r.doc_id: (r.lang, r.source, n[r.doc_id]) for r in kept[3].select("doc_id", "lang", "source").collect()})


def _mixed(docs):
    """The documents (doc_id: lang, source, tokens) that one epoch's budgets reach."""
    leaves = defaultdict(list)
    for i, (lang, source, tokens) in docs.items():
        domain = ["web", "books", "code", "forum"][zlib.crc32((source or "unknown").encode()) % 4]
        leaves[domain, lang or "und", source or "unknown"].append((hashlib.md5(f"{mixing.SEED}:1:{i}".encode()).hexdigest(), i, tokens))
    cap = {k: sum(t for *_, t in v) for k, v in leaves.items()}

    def fill(budget, children, weight):
        """Whole tokens for each child (name: capacity) by weight, full ones first."""
        out, left = {}, dict(children)
        while left:
            level = budget / sum(weight(c) for c in left)
            full = [c for c in left if left[c] / weight(c) <= level]
            if not full:
                return out | {c: int(weight(c) * level) for c in left}
            for c in full:
                out[c] = left.pop(c)
                budget -= out[c]
        return out

    def share(prefix, budget):
        level = len(prefix)
        if level == 3:
            kept = set()
            for _, i, t in sorted(leaves[prefix]):
                budget -= t
                if budget < 0:
                    break
                kept.add(i)
            return kept
        children = Counter()
        for k, c in cap.items():
            if k[:level] == prefix:
                children[k[level]] += c
        weights = mixing.WEIGHTS[mixing.LEVELS[level]]
        return set().union(*(share((*prefix, c), b) for c, b in fill(budget, children, lambda c: weights.get(c, 1)).items()))

    return share((), sum(cap.values()) * corpus_pipeline.MIX_PERCENT // 100)


def test_stages_with_odd_rows_and_clashing_columns(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, nothing, "").count() == 0 and stage(spark, nothing, "").columns == nothing.columns
        assert stage(spark, odd, "").columns == odd.columns
    count = lambda stage: sorted(r.doc_id or 0 for r in stage(spark, odd, "").select("doc_id").collect())
    assert count(corpus_pipeline.language) == [0, 1, 2, 2, 6, 7, 8, 10, 11]
    assert count(corpus_pipeline.exact) == [0, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    assert count(corpus_pipeline.near) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.encode(spark, odd, "").collect()) == sorted(r.doc_id or 0 for r in odd.collect())
    assert corpus_pipeline.encode(spark, nothing, "").count() == 0


def test_near_stage_links_from_80_percent_on(spark):
    a = [f"w{k}" for k in range(104)]
    b = [*a[:94], *(f"x{k}" for k in range(10))]  # 90 of 110 shingles are shared: 0.82
    c = [*a[:91], *(f"y{k}" for k in range(13))]  # 87 of 113: 0.77
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs.where("doc_id <> 3"), "").collect()) == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs.where("doc_id <> 2"), "").collect()) == [1, 3]


@pytest.mark.parametrize("in_files", [True, False])
def test_stages_decide_on_rows(monkeypatch, spark, tmp_path, in_files):
    table = [(1, "one text of some words"), (1, "one text of some words"), (None, "no id but a copy"), (None, "no id but a copy"), (5, "a text that no other row has"), (5, "ten words that two rows have"), (6, "ten words that two rows have"), (None, "alone and without an id")]
    docs = spark.createDataFrame([(*r, "en", "a") for r in table], "doc_id long, text string, lang string, source string")
    if in_files:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))

    def kept(stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        return sorted(((r.doc_id or 0, r.text) for r in out.collect()))

    once = [(0, "alone and without an id"), (0, "no id but a copy"), (1, "one text of some words"), (5, "a text that no other row has")]
    assert kept(corpus_pipeline.exact) == [*once, (6, "ten words that two rows have")]
    assert kept(corpus_pipeline.near) == [*once, (5, "ten words that two rows have")]
    monkeypatch.setattr(corpus_pipeline, "MIX_PERCENT", 100)
    assert kept(corpus_pipeline.mix) == sorted((i or 0, t) for i, t in table)
