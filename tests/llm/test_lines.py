import random

import duckdb

from panelcast.llm.lines import remove_repeated_lines
from panelcast.llm.registry import ORACLES, QUERIES


def brute(rows):
    windows = []
    for i, t in rows:
        lines = t.split("\n") if i is not None and t is not None else []
        windows += [(i, p, tuple(lines[p : p + 3])) for p in range(len(lines) - 2)]
    first, gone, out = {}, {}, []
    for i, p, w in sorted(windows):
        first.setdefault(w, (i, p))
        if "".join(w).strip(" ") and (i, p) > first[w]:
            gone.setdefault(i, set()).update(range(p, p + 3))
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        cut = gone.get(i, set()) if i is not None else set()
        out.append((i, t if not cut or t is None else "\n".join(x for k, x in enumerate(lines) if k not in cut), len(lines), len(cut & set(range(len(lines))))))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {k}" for k in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a\nb"), (203, "a\nb\nc\n"), (204, "x\na\nb\nc\n\n"), (205, "\n\n\n\n"), (206, "\n\n\n\n"), (None, "a\nb\nc\n"), rows[0], rows[0]]
    rows += [(207, "\n".join(f"long {k}" for k in range(30000))), (208, "\n".join(f"long {k}" for k in range(29999, -1, -1))), (209, "new\n" + "\n".join(f"long {k}" for k in range(30000)))]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_lines int, pos string").repartition(5)
    got = remove_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=key) == sorted(brute(rows), key=key)
    assert remove_repeated_lines(df.limit(0)).count() == 0


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(ORACLES["op9_line_dedup"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op9_line_dedup"](spark, folder).collect()) == sorted(want)
