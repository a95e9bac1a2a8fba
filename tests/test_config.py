import json
import random

from cuelake.operators import config

KEYS = ["a", "b.c", 'q"', "d", "~"]


def deep_merge(lower, upper):
    out = dict(lower)
    for k, v in upper.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def plain_leaves(doc, path=()):
    for k, v in doc.items():
        if isinstance(v, dict) and v:
            yield from plain_leaves(v, (*path, k))
        else:
            yield (*path, k), json.dumps(v, separators=(",", ":"))


def document(rng, depth=3):
    out = {}
    for k in rng.sample(KEYS, rng.randrange(0, 4)):
        out[k] = document(rng, depth - 1) if depth and rng.random() < 0.6 else rng.choice([1, "x", None, True, [1, {"z": {}}], {}, []])
    return out


def test_merge_equals_recursion(spark):
    rng = random.Random(5)
    profiles = {p: [document(rng), document(rng)] for p in range(8)}
    entries = {v: {"id": rng.choice(["", f"v{v}"]), "url": rng.choice([None, f"u{v}"]), "overrides": document(rng)} for v in range(40)}
    entries[40], entries[41] = {"id": "plain"}, {"overrides": None}
    defaults = spark.createDataFrame(
        [(p, n, json.dumps(c)) for p, cs in profiles.items() for n, c in enumerate(cs)], "profile long, layer int, config string"
    )
    rows = spark.createDataFrame([(v, v % 8, json.dumps(e)) for v, e in entries.items()], "video_id long, profile long, entry string")
    got = {}
    for r in config.effective(rows, defaults).collect():
        assert got.setdefault(r.video_id, {}).setdefault(tuple(r.path), r.value) is r.value
    for v, entry in entries.items():
        want = deep_merge(deep_merge(*profiles[v % 8]), entry.get("overrides") or {})
        want.update({k: entry[k] for k in ("id", "url") if entry.get(k)})
        assert got.get(v, {}) == dict(plain_leaves(want)), v


def test_nothing_given(spark):
    entries = spark.createDataFrame([(1, 1, '{"overrides": {"a": {"b": 1}}}'), (2, 1, None)], "video_id long, profile long, entry string")
    none = spark.createDataFrame([], "profile long, layer int, config string")
    assert [(r.video_id, r.path, r.value) for r in config.effective(entries, none).collect()] == [(1, ["a", "b"], "1")]
    assert config.effective(entries.limit(0), none).count() == 0
