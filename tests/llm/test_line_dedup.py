from collections import defaultdict

import duckdb

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import line_dedup as ld

SMALL = "/root/testdata/sf0.001"


def brute(rows, min_sites):
    """rows (doc_id, text, site) -> per row (n_lines, n_removed, text)."""
    sites, first = defaultdict(set), {}
    key = lambda d: (d is not None, d or 0)  # noqa: E731  a null id sorts first
    for d, text, site in rows:
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(site or "")
    for d, text, _ in sorted(rows, key=lambda r: key(r[0])):
        for p, line in enumerate((text or "").split("\n")):
            first.setdefault(line.strip(" "), (d, p))
    out = []
    for d, text, _ in rows:
        lines = (text or "").split("\n")
        keep = [x for p, x in enumerate(lines) if not (
            x.strip(" ") and len(sites[x.strip(" ")]) >= min_sites and first[x.strip(" ")] != (d, p))]
        out.append((d, 0 if text is None else len(lines), 0 if text is None else len(lines) - len(keep),
                    None if text is None else "\n".join(keep)))
    return sorted(out, key=str)


def got(df, **how):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in ld.dedup(df, **how).collect()), key=str)


def test_equals_brute_force_with_ties_nulls_and_repeats(documents):
    rows = [(i, f"menu\nline {i % 11}\n  menu  \nown {i}\n", f"site{i % 13}") for i in range(60)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "\n \n", None), (103, "menu", None), (None, "menu\nmenu", "b"), (104, "menu", "c"),
             (7, rows[7][1], "site7"), (105, "x\n" * 3000 + "menu", "d")]
    df = documents([(d, t, "en", s) for d, t, s in rows])
    for k in (2, 5, 8, 13):
        assert got(df, min_sites=k) == brute(rows, k)


def test_counts_near_the_threshold_are_exact(documents):
    rows = [(100 * n + i, f"shared by {n}", f"s{i}") for n in range(300, 320) for i in range(n)]
    df = documents([(d, t, "en", s) for d, t, s in rows])
    assert got(df, min_sites=310) == brute(rows, 310)


def test_lines_of_equal_first_hash_are_told_apart(documents):
    gap = "-" * 24
    one, two = "e8GMJC78" + gap + "wlQR6wBu" + gap, "yVP7YeRh" + gap + "k3c5ilQi" + gap
    rows = [(i, (one, two)[i % 2], f"s{i}") for i in range(10)]
    df = documents([(d, t, "en", s) for d, t, s in rows])
    hashes = ld.lines(df, "doc_id", "text", "source")
    assert hashes.select("h1").distinct().count() == 1 and hashes.select("h2").distinct().count() == 2
    assert got(df, min_sites=8) == brute(rows, 8)


def test_emptied_rows_clashing_columns_and_empty_tables(documents):
    df = documents([(i, "menu", "en", f"s{i}", i) for i in range(9)], ", n_lines int")
    found = ld.dedup(df)
    assert found.columns[:6] == df.columns and found.columns[6:] == ["n_lines_", "n_removed", "emptied"]
    assert sorted((r.doc_id, r.n_lines, r.emptied) for r in found.collect()) == [(i, i, i > 0) for i in range(9)]
    assert ld.dedup(documents([])).count() == 0


def test_the_plan_has_no_python(spark):
    plan = ld.op8_line_dedup(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_over_the_whole_table(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = sorted(tuple(r) for r in c.execute(f"select doc_id, n_lines, n_removed, emptied, text_md5 from ({ld.OP8_SQL})").fetchall())
    assert sorted(tuple(r) for r in ld.op8_line_dedup(spark, SMALL).collect()) == want
