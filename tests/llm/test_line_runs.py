import random
import re

import duckdb
import pytest

from rankmill.llm.line_runs import SQL, dedup_lines, repeated_suffixes

DDL = "doc_id long, text string, n_lines string, rank int"


def slow(rows, min_lines):
    """rows: distinct (doc_id, text) with unique ids, nulls last."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = text.split("\n") if text else []
        solid = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone, own = set(), []
        for s in range(len(solid) - min_lines + 1):
            run = tuple(lines[i] for i in solid[s : s + min_lines])
            if run in seen:
                gone.update(solid[s : s + min_lines])
            seen.add(run)
        for i in solid if min_lines > 1 else ():
            if len([w for w in re.split("[\\x20\\x09-\\x0D]+", lines[i]) if w]) >= 50:
                if (lines[i],) in seen:
                    gone.add(i)
                seen.add((lines[i],))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc] = (text if not text else kept, len(solid), len(gone))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    lines = [f"line {i}" for i in range(60)] + ["", "  ", "\t", "common"]
    runs = [[rng.choice(lines) for _ in range(n)] for n in (2, 3, 5, 9, 17)]
    passages = [" ".join(f"w{i}{k}" for k in range(n)) for i, n in enumerate((48, 49, 50, 51, 80))] + ["\t" + "x " * 50]
    rows = []
    for i in range(120):
        parts = [rng.choice(lines) + ("" if rng.random() < 0.3 else f" {rng.randint(0, 500)}") for _ in range(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(runs)
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(8)] + [(300, None), (301, ""), (302, "\n\n"), (303, "same\n" * 500), (304, "x" * 50000 + "\ny"), (None, rows[3][1])]
    return rows


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4, 7])
def test_matches_brute_force(spark, min_lines):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], DDL).repartition(4)
    got = dedup_lines(docs, min_lines=min_lines)
    assert got.columns == ["doc_id", "text", "rank", "n_lines", "n_removed", "longest_run"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == slow(rows, min_lines)


def test_matches_sql(spark, tmp_path):
    rows = [r for r in corpus(8) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(SQL.format(documents="documents")).fetchall())
    assert sorted(map(tuple, dedup_lines(docs).drop("longest_run").collect())) == want


def test_depths_are_powers_of_the_repeat(spark):
    rows = [(1, i, v) for i, v in enumerate("abcdefgh")] + [(2, i, v) for i, v in enumerate("xabcdefy")] + [(3, i, v) for i, v in enumerate("ab")]
    got = {(r.seq, r.at): r.depth for r in repeated_suffixes(spark.createDataFrame(rows, "seq long, at int, value string"), 2).collect()}
    assert got == {(1, 0): 4, (1, 1): 4, (1, 2): 4, (1, 3): 2, (1, 4): 2, (2, 1): 4, (2, 2): 4, (2, 3): 4, (2, 4): 2, (2, 5): 2, (3, 0): 2}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "c\na\nb"), (3, "q")], "doc_id long, text string")
    assert sorted(map(tuple, dedup_lines(docs).collect())) == [(1, "a\nb", 2, 0, 2), (1, "a\nb", 2, 0, 2), (2, "c", 3, 2, 2), (3, "q", 1, 0, 0)]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_a_long_line_is_a_passage(spark):
    line = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"c\n{line}\nd"), (3, line), (4, line), (5, "short line"), (6, "short line")], "doc_id long, text string")
    assert [(r.doc_id, r.text, r.n_removed) for r in dedup_lines(docs).orderBy("doc_id").collect()] == [
        (1, f"a\n{line}\nb", 0), (2, "c\nd", 1), (3, "", 1), (4, "", 1), (5, "short line", 0), (6, "short line", 0)]
