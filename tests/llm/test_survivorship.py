"""Survivors against a brute-force choice."""

import random
from datetime import datetime

from factweave.llm.survivorship import STAND_INS, slot_survivors
from factweave.operators.candidates import SOURCE_PRIORITY, STATUS_PRIORITY, STATUS_RANK
from tests.helpers import rows

PARAM = "name string, required boolean, `enum` array<string>"
SCHEMA = f"cand_id long, repo string, op_key string, slot_kind string, slot_key string, param struct<{PARAM}>, body struct<schema: string>, response struct<status: string, code: int>, evidence array<struct<source: string>>, confidence double, status string, recorded_at timestamp, extra string"


def fills(v):
    if isinstance(v, list):
        return any(fills(x) for x in v)
    return v is not None and not (isinstance(v, str) and v.strip().lower() in STAND_INS)


def priority(c):
    status = (c["status"] or "").strip().lower()
    best = max([SOURCE_PRIORITY.get((s or "").strip().lower(), 0) for s in c["evidence"] or []] or [0]) or STATUS_PRIORITY.get(status, 0)
    return best * 10.0 + STATUS_RANK.get(status, 0) + (c["confidence"] or 0.0)


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(300):
        data.append({
            "cand_id": i, "repo": rng.choice(["r", "s", None]), "op_key": rng.choice(["GET /a/:id", "get //a/{id}/", "PUT /b"]), "slot_key": rng.choice([" ID", "id", "q"]),
            "param": (rng.choice(["x", "N/A", " ", None, "?"]), rng.choice([True, False, None]), rng.choice([None, [], ["tbd", None], ["a"]])),
            "evidence": rng.choice([None, [], ["source"], ["LLM", " OpenAPI "], ["rumour"]]), "confidence": rng.choice([None, 0.1, 0.9, 0.9]), "status": rng.choice(["verified", " Declared", "conflict", None, "observed"]),
            "recorded_at": rng.choice([None, datetime(2025, 1, 1), datetime(2025, 1, 2)]),
        })
    data += rng.sample(data, 20)
    df = spark.createDataFrame([(c["cand_id"], c["repo"], c["op_key"], "param", c["slot_key"], c["param"], None, None, None if c["evidence"] is None else [(e,) for e in c["evidence"]], c["confidence"], c["status"], c["recorded_at"], "zz") for c in data], SCHEMA)
    groups = {}
    for c in data:
        key = (c["repo"], "PUT /b" if "b" in c["op_key"] else "GET /a/{id}", "param", c["slot_key"].strip().lower())
        groups.setdefault(key, {})[c["cand_id"]] = c
    want = []
    for key, members in groups.items():
        if len(members) < 2:
            continue
        ranked = sorted(members.values(), key=lambda c: (-priority(c), -(c["recorded_at"].timestamp() if c["recorded_at"] else -1e18), c["cand_id"]))
        for k, field in enumerate(("name", "required", "enum")):
            best = next((c for c in ranked if fills(c["param"][k])), None)
            if best:
                want.append((*key, field, best["cand_id"]))
    got = rows(slot_survivors(df.repartition(5)), "repo", "op_key", "slot_kind", "slot_key", "field_name", "cand_id")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edges(spark):
    assert slot_survivors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = (1, "r", "GET /a", "response", "200", None, None, ("200", 0), None, None, None, None, None)
    assert slot_survivors(spark.createDataFrame([one, one], SCHEMA)).count() == 0
    two = (2, "r", "GET /a", "response", "200", None, ("S",), (None, None), None, None, None, None, None)
    assert rows(slot_survivors(spark.createDataFrame([one, two], SCHEMA)), "field_name", "cand_id", "value") == [("code", 1, "0"), ("status", 1, "200")]
