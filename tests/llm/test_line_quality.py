"""Line quality against a plain version and the SQL, with hot lines, and the edge cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from contrail.llm.line_quality import line_quality, line_quality_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs=2, depleted=0.2):
    lines = {}
    for k, (d, t, h) in enumerate(rows):
        plain = re.sub(r"[^\na-z\x80-\U0010ffff]+", " ", (t or "").lower())
        lines[k] = {x.strip(" ") for x in plain.split("\n")} - {""}
    holds = Counter((rows[k][2], x) for k, ls in lines.items() for x in ls)
    out = []
    for k, (d, t, h) in enumerate(rows):
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        raw = [x for x in (t or "").split("\n") if WORD.search(x)]
        total = sum(map(len, lines[k]))
        share = sum(len(x) for x in lines[k] if holds[h, x] > min_docs) / total if total else 0.0
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(raw) - len(set(raw)), len(covered),
                    failed, not failed and share <= depleted, round(share, 9)))
    return out


def corpus():
    r = random.Random(9)
    vocab = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(90)] + ["É##", "漢字", "a|b", "X&<y>"]
    hot = ["Share this page on the net 2024!", "all rights   reserved, forever and for the whole of time by us", " ".join("q" + "ab"[i % 2] * (i + 1) for i in range(60))]
    rows = []
    for d in range(400):
        ls = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(0, 14))]
        if r.random() < .5:
            ls += [hot[0].replace("2024", str(d))] + hot[1:] * r.choice([1, 2])
        if r.random() < .1 and ls:
            ls = [" ".join(x) for x in [r.choice(ls).split()] * 9]
        rows.append((d, r.choice(["\n", "\n\n", " \n\t"]).join(ls), r.choice(["h1", "h1", "h1", "h2", None])))
    rows += [(1000 + k, "\n".join([*hot, "own words here"]), "h1") for k in range(3)]
    return rows + [(2000, None, "h1"), (2001, "", None), (2002, " \n\x0b\x0c\r\t", "h1"), (2003, "a a a a", "h1"), (2004, "x y z " * 30000, "h1")]


def bag(rows):
    return Counter(rows)


def test_against_plain_version_and_sql(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, line int")
    got = [(*tuple(r)[:8], round(r.removed_share, 9)) for r in line_quality(df).collect()]
    want = brute(rows)
    assert bag(got) == bag(want)
    assert any(not w[6] and not w[7] for w in want)
    cols = list(zip(*rows, strict=True))
    documents = pa.table({"doc_id": cols[0], "text": pa.array(cols[1], pa.string()), "source": pa.array(cols[2], pa.string())})  # noqa: F841
    sql = [(*r[:8], round(float(r[8]), 9)) for r in duckdb.sql(line_quality_sql()).fetchall()]
    assert bag(sql) == bag(want)


def test_null_ids_repeated_rows_empty_table(spark):
    rows = [(None, "one two", "h"), (None, None, None), (3, "one two", "h"), (3, "one two", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(*tuple(r)[:8], r.removed_share) for r in line_quality(df, min_docs=1).collect()]
    assert bag(got) == bag(brute(rows, min_docs=1))
    assert line_quality(df.limit(0)).collect() == []


def test_limit_does_not_depend_on_the_host(spark):
    """A line in three documents goes, from a host of four documents and from one of four thousand; one in two stays."""
    def own(d):
        return f"own {'abcdefghij'[d % 10] * (1 + d // 10 % 10)} {'klmnopqrst'[d // 100 % 10] * (1 + d // 1000)}"
    filler = " ".join("x%s" % ("abcdefghij"[i % 10] * (1 + i // 10)) for i in range(60))
    line = "a line of the host that many of its documents hold, from end to end, and at some length"
    rows = [(d, f"{filler} {own(d)}" + (f"\n{line}" if d < n else ""), host) for host, size, n, base in (("small", 4, 3, 0), ("hot", 4000, 3, 0), ("pair", 4, 2, 0))
            for d in range(size)]
    rows = [(1_000_000 * "small hot pair".split().index(h) + d, t, h) for d, t, h in rows]
    got = {r.doc_id: r for r in line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    cut = {d for d, r in got.items() if r.removed_share > 0}
    assert cut == {0, 1, 2, 1_000_000, 1_000_001, 1_000_002}
    assert all(0 < got[d].removed_share < .3 for d in cut) and {d for d in got if not got[d].kept} == {d for d in cut if got[d].removed_share > .2}


def test_rejects_documents_of_the_test_tables(spark):
    for sf, least in (("sf0.01", 3), ("sf0.1", 100)):
        got = line_quality(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
        assert least <= got.where("not kept and not base_failed").count() <= .05 * got.count()
