"""Links of texts that meet on crowded keys only, some known as common and some not."""

import numpy as np

from adlens.llm import similar


def brute(texts):
    sets, of = [set(similar.shingles(t).tolist()) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def test_links_over_common_and_other_crowded_keys_together(spark, monkeypatch):
    """Two texts that are alike only with their beginning, whose shingles are crowded and not known as common: each has a text of its
    common part without it, and a text that is not alike begins the same."""
    texts, common = [], []
    for g in range(4):
        base, other = [f"w{g}.{k}" for k in range(104)], [f"o{g}.{k}" for k in range(94)]
        changed = [f"c{x}" if k in (50, 70, 103) else x for k, x in enumerate(base)]
        group = [base[:10] + other, base, changed, base[6:], changed[6:]]
        texts += [" ".join(x) for x in group]
        rare = set(similar.shingles(" ".join(base[:10])).tolist())
        common += [x for t in texts[-5:] for x in similar.shingles(t).tolist() if x not in rare]
    monkeypatch.setattr(similar, "CROWD", 1)
    monkeypatch.setattr(similar, "_common", lambda _: np.unique(np.array(common, np.int64)))
    monkeypatch.setattr(similar, "_likely", lambda pairs, _: pairs.limit(0))  # what SimHash proposes is left to the join
    found = similar.similar(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    want = brute(texts)
    assert want == [x for g in range(4) for x in (5 * g, *[5 * g + 1] * 4)]
    assert {r.row: r.component for r in found.collect()} == dict(enumerate(want))
