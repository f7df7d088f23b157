"""SimHash in the near-copy stage: what it proposes, and that the stage uses it."""

import random

import corpus_pipeline

from adlens.llm import similar, simhash
from adlens.llm.common import cut
from adlens.llm.components import components


def test_proposed_connects_all_within_the_radius(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(63) for _ in range(30)]
    fps += [fps[k] ^ (1 << rng.randrange(63)) ^ (rng.randrange(2) << rng.randrange(63)) for k in range(20)] + fps[:9]
    pairs = similar.proposed(spark.createDataFrame(list(enumerate(fps)), "id long, fp long"))
    of = {r.node: r.component for r in components(pairs, "t").collect()}
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert [of.get(i, i) for i in range(len(fps))] == want and len(set(want)) == 30


def test_stage_links_by_simhash_first(spark, monkeypatch):
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
        texts += [" ".join(base), " ".join([*base[:60], "changed", *base[61:]]), " ".join([*base, "longer"])]
    links = []
    real = similar._alike

    def spied(pairs, all_texts):
        found = real(pairs, all_texts)
        links.append({frozenset((r.u, r.v)) for r in found.collect()})
        return found

    monkeypatch.setattr(similar, "_alike", spied)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [0, 3, 6, 9, 12, 15]
    fps = [simhash.fingerprint(t, similar.FEATURE) for t in texts]
    near = sum((fps[i] ^ fps[j]).bit_count() <= 2 for i in range(len(fps)) for j in range(i) if i // 3 == j // 3)
    assert near and links[0] and not links[0] & links[1]  # what SimHash linked is not paired again


def test_texts_of_the_same_words_in_another_order_are_not_compared_whole(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(150)]
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(20)]
    texts.append(texts[3] + " longer")
    asked = []
    real = similar._alike

    def spied(pairs, all_texts):
        asked.append({(r.u, r.v) for r in pairs.collect()})
        return real(pairs, all_texts)

    monkeypatch.setattr(similar, "_alike", spied)
    found = similar.similar(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert {r.row: r.component for r in found.collect()} == {k: k if k < 20 else 3 for k in range(21)}
    assert len({simhash.fingerprint(t, similar.FEATURE) for t in texts[:20]}) == 1 and not asked[0] - {(3, 20)}


def test_a_written_step_leaves_no_shuffle_behind(spark):
    tracker = spark._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    found = cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "t")
    assert found.count() == 7
    written = tracker.shuffleStatuses().size() - before
    assert written <= 1  # the count's own
