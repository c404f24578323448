"""tf-idf with few and many terms above the broadcast number."""

import math
from collections import Counter

import pytest

from millrace.operators import features


@pytest.mark.parametrize("repeated", [True, False])
def test_rare_terms_are_joined_and_terms_are_not_shuffled(spark, monkeypatch, repeated):
    texts = {1: "a a b zeta", 2: "A b, c", 3: None, 4: "", 5: "c a eta eta", 6: "theta"}
    more = "a theta"
    rows = [*texts.items(), (6, more)] if repeated else [*texts.items(), (7, more)]
    df = spark.createDataFrame(rows, "id long, text string")
    counts = {i: Counter((t or "").lower().replace(",", "").split()) for i, t in texts.items()}
    if repeated:
        counts[6] = Counter(["theta", "theta", "a"])
    else:
        counts[7] = Counter(more.split())
    seen = Counter(t for c in counts.values() for t in c)
    want = {(i, t, n, seen[t]): n * math.log(8 / (seen[t] + 1)) for i, c in counts.items() for t, n in c.items()}
    for most in (100, 2):
        monkeypatch.setattr(features, "FREQUENT_TERMS", most, raising=False)
        found = features.tf_idf(df, "id", "text")
        got = {(r["id"], r["term"], r["tf"], r["df"]): r["tf_idf"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        if most == 100:
            plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(id" in plan
