"""Registered queries of the dialect's own operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import histogram as H
from .operators import mesh, text
from .session import Engine
from .table import Table

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    for t in TABLES:
        e.register_lazy(t, lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return e


#: name: (statement of the dialect, SQL)
STATEMENTS: dict[str, tuple[str, str]] = {}


def _both(name: str, statement: str, sql: str) -> None:
    STATEMENTS[name] = statement, sql


_KEY = "l_orderkey, l_linenumber"
for _name, _cond, _sql in [
    ("f_range", "l_quantity < 24", "l_quantity < 24"),
    ("f_two_sided", "10 < l_quantity <= 20", "l_quantity > 10 AND l_quantity <= 20"),
    ("f_between", "l_discount between 0.02 and 0.05", "l_discount BETWEEN 0.02 AND 0.05"),
    ("f_in_num", "l_linenumber in (1, 3, 5)", "l_linenumber IN (1, 3, 5)"),
    ("f_in_str", "l_returnflag in ('A', 'R')", "l_returnflag IN ('A', 'R')"),
    ("f_in_exact", "l_orderkey in (1LL, 7LL, 0x20)", "l_orderkey IN (1, 7, 32)"),
    ("f_not_in", "l_linenumber not in (1, 2)", "l_linenumber NOT IN (1, 2)"),
    ("f_str_eq", "'R' = l_returnflag", "l_returnflag = 'R'"),
    ("f_xor", "l_quantity < 10 xor l_tax < 0.03", "(l_quantity < 10) <> (l_tax < 0.03)"),
    ("f_andnot", "l_quantity < 10 andnot l_tax < 0.03", "l_quantity < 10 AND NOT l_tax < 0.03"),
    ("f_not", "!(l_quantity < 10 || l_tax != 0.02)", "NOT (l_quantity < 10 OR l_tax <> 0.02)"),
    ("f_or_and", "l_quantity < 3 or l_quantity > 48 and l_returnflag = 'N'", "l_quantity < 3 OR (l_quantity > 48 AND l_returnflag = 'N')"),
    ("f_expr_vs_expr", "l_extendedprice * l_discount > 1000 + l_quantity * 20", "l_extendedprice * l_discount > 1000 + l_quantity * 20"),
    ("f_not_null", "l_shipdate not null and l_quantity > 45", "l_shipdate IS NOT NULL AND l_quantity > 45"),
    ("f_any_prefix", "any(l_) = 7", "l_orderkey = 7 OR l_partkey = 7 OR l_suppkey = 7 OR l_linenumber = 7 OR l_quantity = 7 OR l_extendedprice = 7 OR l_discount = 7 OR l_tax = 7"),
    ("f_exists", "exists(l_tax) and l_quantity = 1", "l_quantity = 1"),
    ("f_exists_not", "exists(no_such) or l_quantity = 2", "l_quantity = 2"),
    ("f_truthy", "l_quantity % 5 and l_linenumber - 1", "l_quantity % 5 <> 0 AND l_linenumber <> 1"),
]:
    _both(_name, f"select {_KEY} from lineitem where {_cond}", f"SELECT {_KEY} FROM lineitem WHERE {_sql}")
_both("f_like", "select p_partkey, p_name from part where p_name like '%e_' and p_brand like 'Brand%'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_' AND p_brand LIKE 'Brand%'")
_both("f_like_wild", "select p_partkey, p_type from part where p_type like '?*A*'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '_%A%'")
_both("f_not_like", "select p_partkey from part where p_name not like '%a%'", "SELECT p_partkey FROM part WHERE NOT p_name LIKE '%a%'")
_both("f_count", "from lineitem where l_quantity > 30", 'SELECT count(*) AS "count(*)" FROM lineitem WHERE l_quantity > 30')

_D0 = "CASE WHEN {a} <> 0 AND {b} <> 0 THEN {e} ELSE 0.0 END"
_both("s_arith", "select l_orderkey, l_linenumber, l_quantity + l_tax * 2 - -l_discount as v from lineitem", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax * 2 + l_discount AS v FROM lineitem")
_both("s_div0", "select l_orderkey, l_linenumber, l_quantity / l_discount as v, l_tax / l_quantity as w from lineitem", f"SELECT l_orderkey, l_linenumber, {_D0.format(a='l_quantity', b='l_discount', e='l_quantity / l_discount')} AS v, {_D0.format(a='l_tax', b='l_quantity', e='l_tax / l_quantity')} AS w FROM lineitem")
_both("s_mod_pow", "select l_orderkey, l_linenumber, l_quantity % 7 as v, l_quantity ** 2 as w, 2 ^ (l_linenumber - 4) as x from lineitem", "SELECT l_orderkey, l_linenumber, fmod(l_quantity, 7) AS v, pow(l_quantity, 2) AS w, pow(2.0, l_linenumber - 4) AS x FROM lineitem")
_both("s_bits", "select l_orderkey, l_linenumber, (l_orderkey & 12) as v, (l_orderkey | 3) as w from lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey & 12 AS DOUBLE) AS v, CAST(l_orderkey | 3 AS DOUBLE) AS w FROM lineitem")

_both(
    "s_large",
    "select l_orderkey, l_linenumber, floor(l_quantity * 1e20) as a, round(-l_quantity * 1e19) as b, trunc(l_quantity * 1e25) as c, modf(l_quantity * 1e20) as d, "
    "((9223372036854775808 + l_orderkey * 4096) | 4096) as e from lineitem",
    "SELECT l_orderkey, l_linenumber, floor(l_quantity * 1e20) AS a, floor(-l_quantity * 1e19) AS b, trunc(l_quantity * 1e25) AS c, CAST(0 AS DOUBLE) AS d, "
    "CAST(CAST(CAST(9223372036854775808 AS DOUBLE) + l_orderkey * 4096 AS UBIGINT) | CAST(4096 AS UBIGINT) AS DOUBLE) AS e FROM lineitem",
)


def _rounded(*pairs: tuple[str, str]) -> tuple[str, str]:
    ours = ", ".join(f"round({a}, 6) as v{i}" for i, (a, _) in enumerate(pairs))
    sql = ", ".join(f"floor(0.5 + ({b}) * 1000000.0) / 1000000.0 AS v{i}" for i, (_, b) in enumerate(pairs))
    return f"select l_orderkey, l_linenumber, {ours} from lineitem", f"SELECT l_orderkey, l_linenumber, {sql} FROM lineitem"


_both("s_trig", *_rounded(*((f"{f}({x})", f"{f}({x})") for f, x in [("sin", "l_quantity"), ("cos", "l_quantity"), ("tan", "l_discount"), ("asin", "l_discount"), ("acos", "l_discount"), ("atan", "l_quantity"), ("sinh", "l_tax"), ("cosh", "l_tax"), ("tanh", "l_tax"), ("atan2", "l_tax, l_quantity")])))
_both("s_log_exp", *_rounded(("log(l_quantity)", "ln(l_quantity)"), ("log10(l_extendedprice)", "log10(l_extendedprice)"), ("exp(l_tax)", "exp(l_tax)"), ("sqrt(l_quantity)", "sqrt(l_quantity)"), ("pow(l_quantity, 1.5)", "pow(l_quantity, 1.5)")))
_both("s_log_zero", "select count(*) as n from lineitem where 0 <= 10 ** log10(l_discount) < 0.045", "SELECT count(*) AS n FROM lineitem WHERE l_discount < 0.045")
_both("s_round_trunc", "select l_orderkey, l_linenumber, round(l_extendedprice) as a, trunc(-l_extendedprice) as b, round(5 - l_quantity * 1.5) as c, floor(l_tax * 50) as d, ceil(l_tax * 50) as e, fabs(-l_tax) as f, int_from_dict(l_quantity) as g from lineitem",
      "SELECT l_orderkey, l_linenumber, floor(l_extendedprice + 0.5) AS a, trunc(-l_extendedprice) AS b, floor(5 - l_quantity * 1.5 + 0.5) AS c, floor(l_tax * 50) AS d, ceil(l_tax * 50) AS e, l_tax AS f, floor(l_quantity + 0.5) AS g FROM lineitem")
_both("s_round2", "select l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) as a, trunc(l_extendedprice / 7, 1) as b from lineitem", "SELECT l_orderkey, l_linenumber, floor(0.5 + l_extendedprice / 7 * 100.0) / 100.0 AS a, floor(0.5 + l_extendedprice / 7 * 10.0) / 10.0 AS b FROM lineitem")
_both("s_frexp_modf_ldexp", *_rounded(("frexp(l_quantity)", "l_quantity / pow(2.0, floor(log2(l_quantity)) + 1)"), ("modf(l_extendedprice)", "l_extendedprice - trunc(l_extendedprice)"), ("ldexp(l_tax, 3)", "l_tax * 8"), ("fmod(l_extendedprice, 10)", "fmod(l_extendedprice, 10)")))
_both("s_is_fns", "select l_orderkey, l_linenumber, is_zero(l_tax) as a, is_nonzero(l_discount) as b, is_eql(l_tax, l_discount) as c, is_gte(l_tax, l_discount) as d, is_lte(l_tax, l_discount) as e from lineitem",
      "SELECT l_orderkey, l_linenumber, CAST(l_tax = 0 AS DOUBLE) AS a, CAST(l_discount <> 0 AS DOUBLE) AS b, CAST(l_tax = l_discount AS DOUBLE) AS c, CAST(l_tax >= l_discount AS DOUBLE) AS d, CAST(l_tax <= l_discount AS DOUBLE) AS e FROM lineitem")

_both("t_from_unix_hour", "select event_id, from_unixtime_gmt(ts, '%H') as h, from_unixtime_gmt(ts, '%j') as j from events where from_unixtime_gmt(ts, '%M') < 30", "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS h, CAST(dayofyear(ts) AS DOUBLE) AS j FROM events WHERE minute(ts) < 30")
_both("t_from_unix_dow", "select from_unixtime_gmt(ts, '%w') as d, count(*) as n from events", "SELECT CAST(dayofweek(ts) AS DOUBLE) AS d, count(*) AS n FROM events GROUP BY 1")
_both("t_composite", "select event_id from events where strptime(ts, '%Y%m%d') >= 20240110", "SELECT event_id FROM events WHERE CAST(strftime(ts, '%Y%m%d') AS DOUBLE) >= 20240110")
_both("t_to_unix_const", "select event_id from events where ts >= to_unixtime_gmt('2024-01-05', '%Y-%m-%d')", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05'")
_both("t_format_unix", "select event_id, format_unixtime_gmt(ts, '%Y-%m-%d %H:%M:%S') as s from events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events")
_both("t_iso", "select event_id, iso_to_unixtime_gmt(20240101000000 + event_id % 60) as v from events", "SELECT event_id, CAST(1704067200 + event_id % 60 AS DOUBLE) AS v FROM events")

_both("a_basic", "select l_returnflag, l_linestatus, sum(l_quantity) as sq, avg(l_extendedprice) as ap, min(l_tax) as mn, max(l_shipdate) as mx, count(*) as n from lineitem where l_quantity < 24",
      "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sq, avg(l_extendedprice) AS ap, min(l_tax) AS mn, max(l_shipdate) AS mx, count(*) AS n FROM lineitem WHERE l_quantity < 24 GROUP BY 1, 2")
_both("a_global", "select count(*) as n, sum(o_totalprice) as s, min(o_orderdate) as a, max(o_orderpriority) as b from orders", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderdate) AS a, max(o_orderpriority) AS b FROM orders")
_both("a_countd", "select o_orderpriority, countd(o_custkey) as c, countdistinct(o_orderstatus) as d from orders", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY 1")
_both("a_median_int", "select l_returnflag, median(l_partkey) as m from lineitem", "SELECT l_returnflag, CAST(trunc(median(l_partkey)) AS BIGINT) AS m FROM lineitem GROUP BY 1")
_both("a_median_dbl", "select l_returnflag, median(l_extendedprice) as m from lineitem", "SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1")
_both("a_var_std", "select l_linenumber, round(varp(l_quantity), 4) as a, round(var(l_quantity), 4) as b, round(stdpop(l_quantity), 4) as c, round(stdev(l_quantity), 4) as d from lineitem",
      "SELECT l_linenumber, floor(0.5 + 10000 * var_pop(l_quantity)) / 10000 AS a, floor(0.5 + 10000 * var_samp(l_quantity)) / 10000 AS b, floor(0.5 + 10000 * stddev_pop(l_quantity)) / 10000 AS c, floor(0.5 + 10000 * stddev_samp(l_quantity)) / 10000 AS d FROM lineitem GROUP BY 1")
_both("a_var_one", "select n_nationkey, stdev(n_regionkey) as s, var(n_regionkey) as v from nation", "SELECT n_nationkey, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS v FROM nation")
_both("a_concat", "select n_regionkey, group_concat(n_name) as names from nation", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
_both("a_post_arith", "select l_returnflag, countdistinct(l_suppkey) / count(*) as r, 99 - min(l_linenumber) as m, sum(l_tax) * 2 + max(l_discount) as s from lineitem",
      "SELECT l_returnflag, count(DISTINCT l_suppkey) / count(*) AS r, CAST(99 - min(l_linenumber) AS DOUBLE) AS m, sum(l_tax) * 2 + max(l_discount) AS s FROM lineitem GROUP BY 1")
_both("a_expr_key", "select floor(l_quantity / 10) as q, avg(l_tax) as t, count(*) as n from lineitem where l_discount < 0.05", "SELECT floor(l_quantity / 10) AS q, avg(l_tax) AS t, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY 1")
_both("a_alias_where", "select l_quantity * 2 as q, count(*) as n from lineitem where q > 60", "SELECT l_quantity * 2 AS q, count(*) AS n FROM lineitem WHERE l_quantity * 2 > 60 GROUP BY 1")

_both("o_multi", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
_both("o_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 17", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 17")
_both("o_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 5, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 5")
_both("o_topk", "select o_custkey, sum(o_totalprice) as s from orders order by s desc, o_custkey limit 10", "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1 ORDER BY s DESC, o_custkey LIMIT 10")

_both("j_on", "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where c.c_acctbal > 5000 and o.o_totalprice > 100000", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100000")
_both("j_where", "select l.l_orderkey, l.l_linenumber, p.p_brand from lineitem l, part p where l.l_partkey = p.p_partkey and p.p_size < 10", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem, part WHERE l_partkey = p_partkey AND p_size < 10")
_both("j_using", "select a.n_name, b.n_regionkey, count(*) as n from nation a join nation b using n_regionkey", "SELECT a.n_name, b.n_regionkey, count(*) AS n FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1, 2")
_both("j_self", "select a.s_suppkey as x, b.s_suppkey as y from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
_both("j_band_between", "select a.event_id as x, b.event_id as y from events a, events b where a.event_id - b.event_id between 1 and 3", "SELECT a.event_id AS x, b.event_id AS y FROM events a, events b WHERE a.event_id - b.event_id BETWEEN 1 AND 3")
_both("j_band_strict", "select a.c_custkey as x, b.c_custkey as y from customer a join customer b on -10.5 < a.c_acctbal - b.c_acctbal and a.c_acctbal < b.c_acctbal + 10.5", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_acctbal - b.c_acctbal > -10.5 AND a.c_acctbal < b.c_acctbal + 10.5")
_both(
    "j_band_bounds",
    "select a.c_custkey as x, b.c_custkey as y from customer a join customer b on a.c_acctbal - b.c_acctbal > 5 and a.c_acctbal - b.c_acctbal > 1 "
    "and a.c_acctbal - b.c_acctbal <= 10.5 and a.c_acctbal - b.c_acctbal < 10.5 and a.c_acctbal - b.c_acctbal < 40",
    "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_acctbal - b.c_acctbal > 5 AND a.c_acctbal - b.c_acctbal < 10.5",
)
_both("j_band_columns", "select a.p_partkey as x, b.s_suppkey as y from part a join supplier b on a.p_retailprice between b.s_acctbal - 20 and b.s_acctbal + 30", "SELECT p_partkey AS x, s_suppkey AS y FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 20 AND s_acctbal + 30")
_both("j_agg", "select c.c_mktsegment, sum(o.o_totalprice) / count(*) as v, count(*) as n from orders o join customer c on o.o_custkey = c.c_custkey", "SELECT c_mktsegment, avg(o_totalprice) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_both("j_three", "select r.r_name, count(*) as n from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")

_both("x_contains_one", "select doc_id from documents where text contains 'the'", r"SELECT doc_id FROM documents WHERE list_contains(list_transform(regexp_extract_all(text, '''[^'']*''|""[^""]*""|[^;, \x0B\x08\f\r\t\n''""]+'), lambda x: trim(regexp_replace(x, '^[''""]|[''""]$', '', 'g'))), 'the')".replace('""', '"'))
_both("x_contains_all", "select doc_id from documents where text contains ('the', 'and', 'of')", r"SELECT doc_id FROM documents WHERE list_has_all(list_transform(regexp_extract_all(text, '''[^'']*''|""[^""]*""|[^;, \x0B\x08\f\r\t\n''""]+'), lambda x: trim(regexp_replace(x, '^[''""]|[''""]$', '', 'g'))), ['the', 'and', 'of'])".replace('""', '"'))
_both("x_text_in", "select doc_id from documents where lang in ('en', 'fr') and source like 'src1%'", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source LIKE 'src1%'")

_AX = [("l_quantity", 0.0, 50.0, 7.0), ("l_discount", 0.0, 0.1, 0.03), ("l_tax", 0.0, 0.08, 0.05)]


def h_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).histogram(_AX[0], where="l_returnflag = 'R'").drop("bin")


def h_1d_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).histogram(_AX[0], weight="l_extendedprice").drop("bin")


def h_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).histogram(*_AX[:2])


def h_2d_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).histogram(*_AX[:2], weight="l_extendedprice")


def h_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).histogram(*_AX)


def h_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).cumulative(_AX[0])


def h_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.joint(engine(spark, sf_dir).relation("lineitem"), "l_quantity", "l_linenumber", [10, 20, 40], [2, 5])


def h_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.distribution(engine(spark, sf_dir).relation("lineitem"), "l_quantity", [5, 10, 25]).select("bin", "value")


def h_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("orders")).bins(("o_totalprice", 0.0, 400000.0, 50000.0), row_id="o_orderkey", where="o_orderstatus = 'F'")


def h_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).adaptive(["l_extendedprice", "l_linenumber"], [8, 4])


def h_adaptive_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("lineitem")).adaptive(["l_linenumber"], [20]).select("low0", "value")


def x_term_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_document(engine(spark, sf_dir).relation("part"), "p_name", "p_partkey")


def x_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keyword_counts(engine(spark, sf_dir).relation("part"), "p_name", "p_partkey")


def x_term_doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_document(engine(spark, sf_dir).relation("documents"), "text", "doc_id")


def x_keyword_counts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keyword_counts(engine(spark, sf_dir).relation("documents"), "text", "doc_id")


def m_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Table(engine(spark, sf_dir).relation("nation"))
    return n.append(n.select("n_nationkey, n_name, n_regionkey", "n_regionkey = 1")).df


def m_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.store import deactivated

    return deactivated(engine(spark, sf_dir).relation("nation"), "n_regionkey > 2")


def m_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, commit, rollback, soft delete, reactivation and purge of a table on disk."""
    import uuid

    from .sources.store import Store, shared_folder

    n = engine(spark, sf_dir).relation("customer")
    s = Store(spark, f"{shared_folder(spark)}/lakegrain/store-{uuid.uuid4().hex}")
    s.write(n.filter("c_custkey % 3 = 0"), "p")
    s.append(n.filter("c_custkey % 3 <> 0"), "p")
    s.commit("p")
    s.append(n, "p")
    s.rollback("p")
    s.deactivate("p", "c_acctbal < 1000")
    s.reactivate("p", "c_acctbal < 0")
    s.purge("p")
    return s.read("p").select("c_custkey", "c_acctbal")


def m_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(engine(spark, sf_dir).relation("nation")).add_column("n_nationkey * 2 + 1", "v").df


def m_partition_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    n = e.relation("nation")
    for i in range(3):
        e.register(f"t{i}", n.filter(F.col("n_regionkey") == i))
    return e.sql("select n_regionkey, count(*) as n from 't_'")


_SHAPE = [100, 10, 7]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a condition on lineitem as cells of a mesh: order, line number and quantity tell the cell."""
    li = engine(spark, sf_dir).relation("lineitem").filter("l_quantity > 12")
    return li.select((F.col("l_orderkey") % 100 * 70 + F.col("l_partkey") % 10 * 7 + F.col("l_linenumber") - 1).alias("cell")).distinct()


def g_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.with_coordinates(_cells(spark, sf_dir), "cell", _SHAPE)


def g_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.lines(_cells(spark, sf_dir), "cell", _SHAPE)


def g_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.components(_cells(spark, sf_dir).filter("cell % 3 <> 0"), "cell", _SHAPE)


def g_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.blocks(*_order_cells(spark, sf_dir))


def g_block_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.connected_blocks(*_order_cells(spark, sf_dir))


def g_hyperslab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.hyperslab(_cells(spark, sf_dir), "cell", _SHAPE, [(0, 50, 2), (1, 9, 3), (0, 7, 1)])


def _order_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, list[int]]:
    """Hits of a condition as cells of the mesh of all orders and line numbers, which the largest keys give; each line item has its own."""
    li = engine(spark, sf_dir).relation("lineitem")
    top = li.agg(F.max("l_orderkey"), F.max("l_linenumber")).first()
    shape = [int(n or 0) + 1 for n in top]
    hits = li.filter("l_quantity > 12").select((F.col("l_orderkey") * shape[1] + F.col("l_linenumber")).alias("cell")).distinct()
    return hits, "cell", shape


def g_coords_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.with_coordinates(*_order_cells(spark, sf_dir))


def g_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.lines(*_order_cells(spark, sf_dir))


def g_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.components(*_order_cells(spark, sf_dir))


def g_hyperslab_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, cell, shape = _order_cells(spark, sf_dir)
    return mesh.hyperslab(hits, cell, shape, [(0, shape[0] // 2, 2), (1, shape[1], 3)])


_CELLS = "(SELECT DISTINCT l_orderkey % 100 * 70 + l_partkey % 10 * 7 + l_linenumber - 1 AS cell FROM lineitem WHERE l_quantity > 12)"


def _hist_sql(axes, value: str, where: str = "true", number: bool = True) -> str:
    sizes = [H.n_bins(*a[1:]) for a in axes]
    cells = ", ".join(f"CAST(floor(({c} - {b}) / {s}) AS INT) AS bin{i}" for i, (c, b, _, s) in enumerate(axes))
    inside = " AND ".join(f"{c} BETWEEN {b} AND {e}" for c, b, e, _ in axes)
    every = ", ".join(f"range({n}) AS r{i}(bin{i})" for i, n in enumerate(sizes))
    names = ", ".join(f"bin{i}" for i in range(len(axes)))
    linear = "0"
    for i, n in enumerate(sizes):
        linear = f"({linear}) * {n} + bin{i}"
    return f"SELECT {f'CAST({linear} AS BIGINT) AS bin, ' if number else ''}{names}, coalesce(value, 0) AS value FROM (SELECT {', '.join(f'CAST(bin{i} AS INT) AS bin{i}' for i in range(len(axes)))} FROM {every}) LEFT JOIN (SELECT {names}, {value} AS value FROM (SELECT *, {cells} FROM lineitem WHERE {inside} AND {where}) GROUP BY {names}) USING ({names})"


#: Cells of _order_cells with their coordinates, and the shape of the mesh.
_ORDER_CELLS = """(SELECT DISTINCT l_orderkey * n1 + l_linenumber AS cell, l_orderkey AS c0, CAST(l_linenumber AS BIGINT) AS c1, n0, n1
FROM lineitem, (SELECT max(l_orderkey) + 1 AS n0, max(l_linenumber) + 1 AS n1 FROM lineitem) WHERE l_quantity > 12)"""
#: Keywords of whole documents, as in x_contains_one.
_TERMS = r"""(SELECT DISTINCT term, doc FROM (SELECT unnest(list_transform(regexp_extract_all(text, '''[^'']*''|"[^"]*"|[^;, \x0B\x08\f\r\t\n''"]+'), lambda x: trim(regexp_replace(x, '^[''"]|[''"]$', '', 'g')))) AS term, doc_id AS doc FROM documents) WHERE term <> '')"""

FUNCTION_SQL = {
    "h_1d": _hist_sql(_AX[:1], "count(*)", "l_returnflag = 'R'", number=False),
    "h_1d_weighted": _hist_sql(_AX[:1], "sum(l_extendedprice)", number=False),
    "h_2d": _hist_sql(_AX[:2], "count(*)"),
    "h_2d_weighted": _hist_sql(_AX[:2], "sum(l_extendedprice)"),
    "h_3d": _hist_sql(_AX, "count(*)"),
    "h_cumulative": f"SELECT CAST(bin AS BIGINT) AS bin, value, CAST(sum(value) OVER (ORDER BY bin) AS BIGINT) AS total FROM ({_hist_sql(_AX[:1], 'count(*)')})",
    "h_joint": "SELECT CAST((l_quantity >= 10) AS INT) + CAST((l_quantity >= 20) AS INT) + CAST((l_quantity >= 40) AS INT) AS bin0, CAST((l_linenumber >= 2) AS INT) + CAST((l_linenumber >= 5) AS INT) AS bin1, count(*) AS value FROM lineitem GROUP BY 1, 2",
    "h_distribution": "SELECT CAST((l_quantity >= 5) AS INT) + CAST((l_quantity >= 10) AS INT) + CAST((l_quantity >= 25) AS INT) AS bin, count(*) AS value FROM lineitem GROUP BY 1",
    "h_bins": "SELECT CAST(floor(o_totalprice / 50000.0) AS INT) AS bin0, o_orderkey AS row_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 0 AND 400000",
    "h_adaptive_few": "SELECT CAST(l_linenumber AS DOUBLE) AS low0, count(*) AS value FROM lineitem GROUP BY 1",
    "x_term_doc": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term, p_partkey AS doc FROM part",
    "x_keyword_counts": "SELECT term, count(*) AS n_docs FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term, p_partkey FROM part) GROUP BY 1",
    "x_term_doc_text": f"SELECT term, doc FROM {_TERMS}",
    "x_keyword_counts_text": f"SELECT term, count(*) AS n_docs FROM {_TERMS} GROUP BY 1",
    "m_append": "SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1",
    "m_delete_where": "SELECT * FROM nation WHERE NOT n_regionkey > 2",
    "m_store": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal >= 1000",
    "m_add_column": "SELECT *, CAST(n_nationkey * 2 + 1 AS DOUBLE) AS v FROM nation",
    "m_partition_like": "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY 1",
    "g_coords": f"SELECT cell, cell // 70 % 100 AS c0, cell // 7 % 10 AS c1, cell % 7 AS c2 FROM {_CELLS}",
    "g_lines": f"SELECT c0, c1, min(c2) AS first, max(c2) AS last FROM (SELECT cell // 70 AS c0, cell // 7 % 10 AS c1, cell % 7 AS c2, cell % 7 - row_number() OVER (PARTITION BY cell // 7 ORDER BY cell) AS g FROM {_CELLS}) GROUP BY c0, c1, g",
    "g_hyperslab": f"SELECT cell FROM {_CELLS} WHERE cell // 70 < 50 AND cell // 70 % 2 = 0 AND cell // 7 % 10 BETWEEN 1 AND 8 AND (cell // 7 % 10 - 1) % 3 = 0",
    "g_coords_all": f"SELECT cell, c0, c1 FROM {_ORDER_CELLS}",
    "g_lines_all": f"SELECT c0, min(c1) AS first, max(c1) AS last FROM (SELECT c0, c1, c1 - row_number() OVER (PARTITION BY c0 ORDER BY c1) AS g FROM {_ORDER_CELLS}) GROUP BY c0, g",
    "g_hyperslab_all": f"SELECT cell FROM {_ORDER_CELLS} WHERE c0 < n0 // 2 AND c0 % 2 = 0 AND c1 >= 1 AND (c1 - 1) % 3 = 0",
    "g_components": f"""WITH RECURSIVE h AS (SELECT cell, cell // 70 AS a, cell // 7 % 10 AS b, cell % 7 AS c FROM {_CELLS} WHERE cell % 3 <> 0),
e AS (SELECT x.cell AS u, y.cell AS v FROM h x JOIN h y ON abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) = 1),
r(cell, reach) AS (SELECT cell, cell FROM h UNION SELECT r.cell, e.v FROM r JOIN e ON e.u = r.reach),
k AS (SELECT cell, min(reach) AS component FROM r GROUP BY cell)
SELECT c0, c1, min(c2) AS first, max(c2) AS last, min(component) AS component FROM (SELECT cell // 70 AS c0, cell // 7 % 10 AS c1, cell % 7 AS c2, component, cell % 7 - row_number() OVER (PARTITION BY cell // 7 ORDER BY cell) AS g FROM k) GROUP BY c0, c1, g""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(STATEMENTS["a_basic"][0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: (lambda s, d, q=q: engine(s, d).sql(q)) for n, (q, _) in STATEMENTS.items()}
    return out | {n: f for n, f in globals().items() if n[:2] in ("h_", "x_", "m_", "g_") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in STATEMENTS.items()} | FUNCTION_SQL
