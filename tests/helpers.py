"""A pure sequential interpreter of the merge, and small builders."""

from __future__ import annotations

from loomfold.schema import table

NOTES = table("notes", 5, {"k": "i64"}, {"a": "text", "b": "i64"})
SCHEMA = "seq bigint, k bigint, kind string, ts bigint, a_set boolean, a string, b_set boolean, b bigint"


def up(ts, k=1, **sets):
    return ("U", ts, k, sets)


def down(ts, k=1):
    return ("D", ts, k, {})


def frame(spark, ops):
    rows = [(i, k, kind, ts, "a" in s, s.get("a"), "b" in s, s.get("b")) for i, (kind, ts, k, s) in enumerate(ops)]
    return spark.createDataFrame(rows, SCHEMA)


def _rank(v):
    return (v is not None, v if v is not None else 0)


def sequential(ops):
    """(live rows {k: (a, b)}, events [(seq, kind, changed)]) by applying one operation after the other."""
    rows, events = {}, []
    for seq, (kind, ts, k, sets) in enumerate(ops):
        new = k not in rows
        r = rows.setdefault(k, {"u": 0, "d": 0, "a": (0, None), "b": (0, None)})
        if kind == "D":
            if new or ts > r["d"]:
                events.append((seq, "D", []))
                r["d"] = max(r["d"], ts)
                for c in "ab":
                    if r[c][0] < ts:
                        r[c] = (0, None)
            continue
        if not new and ts < r["d"]:
            continue
        wins = [c for c, v in sets.items() if (ts, _rank(v)) > (r[c][0], _rank(r[c][1]))]
        again = [c for c, v in sets.items() if (ts, _rank(v)) == (r[c][0], _rank(r[c][1]))]
        if new or ts > r["u"] or wins:
            events.append((seq, "U", sorted(wins + again)))
        for c in wins:
            r[c] = (ts, sets[c])
        r["u"] = max(r["u"], ts)
    live = {k: (r["a"][1], r["b"][1]) for k, r in rows.items() if r["u"] >= r["d"] and r["u"] > 0}
    return live, events
