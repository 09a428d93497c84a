"""Canonical JSON against Python's own, and exact retrieval in blocks."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from provenlake.functions import canonical
from provenlake.operators import verdict

KIND = S.StructType([S.StructField("v", S.StringType()), S.StructField("é", S.DoubleType()), S.StructField("B", S.ArrayType(S.MapType(S.StringType(), S.LongType()))), S.StructField("a", S.StructType([S.StructField("z", S.BooleanType()), S.StructField("n", S.IntegerType())]))])


def test_canonical_json(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices('ab"\\\n\r\t\f\b\x00\x01\x0b\x1f\x7f/é日🙂 ', k=rng.randint(0, 9))) for _ in range(60)]
    floats = [0.0, -0.0, 1.0, 0.1, -2.5, 1e16, 1e15, 123456789.125, 1e22, 1.5e300, 0.001, 0.0001, 0.00012, 1e-05, -1.25e-07, 1e-100, math.inf, -math.inf, 9007199254740993.0, 12345678.9, 1e7, 99999999999999.98]
    rows = []
    for k, text in enumerate(texts):
        maps = [{t: rng.choice([None, 3]) for t in rng.sample(texts, 2)}, None, {}] if k % 3 else None
        rows.append((text if k % 5 else None, floats[k % len(floats)], maps, (k % 2 == 0, k) if k % 4 else None))
    df = spark.createDataFrame(rows, KIND)
    found = canonical.with_canonical(df, df.columns).collect()
    for r in found:
        want = {"v": r["v"], "é": r["é"], "B": r["B"], "a": r["a"].asDict() if r["a"] else None}
        assert r.canonical == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    # the order of the fields changes nothing
    turned = canonical.with_canonical(df, df.columns[::-1]).collect()
    assert [r.canonical_hash for r in turned] == [r.canonical_hash for r in found]
    with pytest.raises(TypeError):
        canonical.json_text(F.lit(1), S.TimestampType())


@pytest.mark.parametrize("block", [7, 2048])
def test_retrieval_in_blocks(spark, monkeypatch, block):
    """Equal cosines keep the earlier passage, in large bundles and small ones."""
    monkeypatch.setattr(verdict, "BLOCK_ROWS", block)
    rng = random.Random(2)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    claims = [(rng.choice([1, 1, 1, 2, 3]), f"c{k}", vector()) for k in range(60)] + [(1, "none", None)]
    passages = [(rng.choice([1, 1, 2, 4]), f"p{k}", k, vector()) for k in range(90)] + [(1, "none", 900, None)]
    found = verdict.retrieve(spark.createDataFrame(claims, "bundle_id int, claim_id string, embedding array<float>"), spark.createDataFrame(passages, "bundle_id int, passage_id string, ordinal int, embedding array<float>").repartition(3))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = []
    for b, c, v in claims:
        scored = sorted((-math.floor(unit(v) @ unit(w) * 1e6 + 0.5) / 1e6, o, p) for d, p, o, w in passages if v and w and b == d)
        want += [(b, c, p, -s, n) for n, (s, o, p) in enumerate(scored[:5], 1)]
    assert sorted((r.bundle_id, r.claim_id, r.passage_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
