import collections
import random
import re

from tracekit.llm import line_quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(ws) - 7):
        windows[tuple(ws[i : i + 8])].append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    rng = random.Random(3)
    bits = ["a", "b", "été", "c#", "$%", "\n", "\n", "\t", "\x0b", " x", "\U0001f600"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 120))) for _ in range(200)] + [None, "", " \n ", "a b c d e f g h " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.with_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text


def test_common_lines_deplete_documents(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    stock = " ".join(f"s{k}" for k in range(100))
    rows = [(i, "h", f"{stock}\n{own(i)}") for i in range(6)] + [(10, "other", f"{stock}\n{own(10)}"), (11, "h", f"  {stock.upper()} "), (12, None, None), (13, "h", own(13)), (13, "h", own(13))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", Q.F.lit(1))
    got = collections.defaultdict(list)
    for r in Q.quality_rules(df, least_docs=5, min_left=0.2).collect():
        got[r.doc_id].append((r.kept, r.words_removed))
    assert got[0] == [(True, 100)] and got[10] == [(True, 0)] and got[11] == [(False, 100)]
    assert got[12] == [(False, 0)] and got[13] == [(True, 0)] * 2
    assert Q.quality_rules(df.limit(0)).count() == 0


def test_registered_limits_remove_boilerplate_of_small_and_large_hosts(spark, tmp_path):
    from tracekit.llm.queries import QUERIES

    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    stock = " ".join(f"s{k}" for k in range(100))
    rows = [(i, "small", f"{stock}\n{own(i)}") for i in range(6)] + [(i, "large", (f"{stock}\n" if i < 130 else "") + own(i)) for i in range(10, 5000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.kept, r.words_removed) for r in QUERIES["op10_line_quality"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, _, text in rows:
        assert got[i] == ((False, 100) if stock in text else (True, 0))


def test_query_against_its_sql(spark):
    import duckdb

    from tracekit.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES["op10_line_quality"](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op10_line_quality']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want) and sum(r[-1] for r in got) > 0
