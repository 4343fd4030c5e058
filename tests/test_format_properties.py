"""Text formats on many random values against direct Python statements of the same rules."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from skewlens.functions.format import metric_line, pretty_bytes, pretty_time

UNITS = [("EB", 60), ("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10)]


def py_bytes(n: int) -> str:
    for unit, shift in UNITS:
        if n >= 1 << shift:
            return f"{n >> shift} {unit}"
    return f"{n} bytes"


def py_time(s: int) -> str:
    def trunc_div(a, b):
        return int(a / b) if abs(a) < 2**52 else (abs(a) // b) * (1 if a >= 0 else -1)
    h = trunc_div(s, 3600)
    rem = s - h * 3600
    m = trunc_div(rem, 60)
    sec = rem - m * 60
    return f"{h:4d}:{m:02d}:{sec:02d}"


def py_ratio(x: float) -> str:
    return str(Decimal(repr(x)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def test_bytes_and_time_on_random_values(spark):
    rng = random.Random(11)
    values = [rng.choice([0, 1, 1023, 1024]) for _ in range(10)]
    values += [rng.randrange(0, 1 << rng.randrange(1, 63)) for _ in range(400)]
    values += [-rng.randrange(1, 10**6) for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = df.select("v", pretty_bytes(F.col("v")).alias("b"),
                    pretty_time(F.col("v") % (10**8)).alias("t")).collect()
    for r in got:
        assert r.b == py_bytes(r.v), r.v
        s = r.v % (10**8) if r.v >= 0 else -((-r.v) % (10**8))
        assert r.t == py_time(s), r.v


def test_ratio_text_rounds_half_up_on_shortest_decimal(spark):
    rng = random.Random(5)
    values = [k / 1000 for k in range(0, 3000, 5)]                   # many exact .xx5 cases
    values += [rng.uniform(0, 1000) for _ in range(300)] + [rng.randrange(1, 10**7) / rng.randrange(1, 999)
                                                             for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    line = metric_line(F.lit("m"), F.lit("a"), F.lit("b"), F.col("r"), F.lit(False))
    for r in df.select("r", line.alias("l")).collect():
        assert r.l.rsplit("Ratio: ", 1)[1] == py_ratio(r.r), r.r


def test_json_double_text_matches_the_oracle_emulation(spark):
    import duckdb
    from skewlens.plans.oracle import java_double_sql
    rng = random.Random(3)
    values = [0.0, 1e7, 1e-3, 1e-4, 9999999.999, 0.001, 123.0]
    values += [rng.uniform(1, 10) * 10 ** rng.randrange(-8, 16) for _ in range(400)]
    values += [rng.randrange(1, 10**6) / rng.randrange(1, 10**5) for _ in range(200)]
    values += [-v for v in values[7:60]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.x: r.j[5:-1] for r in df.select("x", F.to_json(F.struct("x")).alias("j")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    want = dict(con.sql(f"SELECT x, {java_double_sql('x')} FROM t").fetchall())
    bad = [(v, got[v], want[v]) for v in values if got[v] != want[v]]
    assert not bad, bad[:5]
