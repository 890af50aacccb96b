"""Registered queries of the library's operators, each with DuckDB SQL.

The formats the library reads are not among the test tables, so most queries build real
catalogs, scripts, archives or packed blobs from a whole table and read them back; the SQL states
over the table itself what must come out."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.codecs import cbg, dsc
from lexloom.codecs import lz as lz_codec
from lexloom.functions import binary as B
from lexloom.functions import text as T
from lexloom.operators import catalogs as K
from lexloom.operators import images as I
from lexloom.operators import scripts as S
from lexloom.plans import programs
from lexloom.sinks import archives as AW
from lexloom.sinks import scripts as SW
from lexloom.sources import archives as AR
from lexloom.sources import catalogs as C
from lexloom.sources.scripts import LINE, PUSH_INT, PUSH_PTR, PUSH_STR, TEXT, read_ops

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- shared shapes -------------------------------------------------------------------------

#: User turns as source texts; the assistant turn right after one is its translation.
_PAIRS = """pairs AS (SELECT conv_id, turn, text AS msgid, CASE WHEN next_role = 'assistant' AND next_turn = turn + 1 THEN next_text ELSE '' END AS msgstr FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").withColumns({f"next_{c}": F.lead(c).over(w) for c in ("role", "turn", "text")})
    said = F.when((F.col("next_role") == "assistant") & (F.col("next_turn") == F.col("turn") + 1), F.col("next_text")).otherwise("")
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("msgid"), said.alias("msgstr"))


def _ascii(c: str) -> Column:
    return F.regexp_replace(c, r"[^\x20-\x7E\n]", "?")


#: The same in SQL. Engines differ on what a letter is, and on characters and bytes.
_ASCII = "regexp_replace({}, '[^\\x20-\\x7E\\n]', '?', 'g')"
#: Tokens of a text: words, and what is between them unless it is blank.
_TOKENS = "(len(regexp_extract_all({0}, '[A-Za-z0-9_]+')) + len(regexp_extract_all({0}, '[^A-Za-z0-9_]*[^A-Za-z0-9_\\s][^A-Za-z0-9_]*')))::BIGINT"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    file = F.col("conv_id").cast("string")
    return _pairs(spark, d).select(file.alias("file"), F.col("turn").cast("int").alias("entry_idx"), "msgid", "msgstr", F.array(F.format_string(": %s:%d", file, "turn")).alias("comments"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """A script per conversation: for each turn a line op, its role and text pushed, a text op,
    and, after it, a pointer to the start of the turn."""
    arg = lambda kind, i=None, s=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if i is None else i).cast("int").alias("i"), (F.lit(None) if s is None else s).cast("string").alias("s"))
    none = F.array().cast("array<struct<kind:string,i:int,s:string>>")
    op = lambda kind, args: F.struct(F.lit(kind).alias("type"), args.alias("args"))
    made = F.array(
        op(LINE, F.array(arg("STR", s=F.lit("conv")), arg("INT", i=F.col("turn")))),
        op(PUSH_STR, F.array(arg("STR", s=F.col("role")))),
        op(PUSH_STR, F.array(arg("STR", s=F.col("text")))),
        op(TEXT, none),
        op(PUSH_PTR, F.array(arg("PTR", i=F.col("n") * 40))),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = _t(spark, d, "conversations").withColumn("n", place)
    rows = rows.select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(made).alias("sub", "op"))
    idx = F.row_number().over(Window.partitionBy("file").orderBy("turn", "sub")) - 1
    return rows.select("file", idx.alias("op_idx"), F.lit(0).alias("ori_pos"), "op.type", "op.args")


def _catalog_lines(entries: DataFrame) -> DataFrame:
    return C.as_lines(C.joined(C.po_lines(entries), "entry_idx"))


def _event_ops(spark: SparkSession, d: str) -> DataFrame:
    """A script per user: sign-ups are line ops with the event's id, views and clicks push it,
    purchases are texts."""
    arg = lambda i: F.struct(F.lit("INT").alias("kind"), i.cast("int").alias("i"), F.lit(None).cast("string").alias("s"))
    kind = F.when(F.col("event_type") == "signup", LINE).when(F.col("event_type").isin("view", "click"), PUSH_INT).when(F.col("event_type") == "purchase", TEXT).otherwise(0x22)
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    args = F.when(kind == LINE, F.array(arg(F.lit(0)), arg(F.col("event_id")))).otherwise(F.array(arg(F.col("event_id"))))
    return _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), idx.alias("op_idx"), F.lit(0).alias("ori_pos"), kind.alias("type"), args.alias("args"))


def _script_archives(spark: SparkSession, d: str, arcs: Column, ops: DataFrame | None = None) -> DataFrame:
    """The scripts, as s and the conversation's number, packed into archives."""
    rows = SW.write_ops(_ops(spark, d) if ops is None else ops).select(F.explode(arcs).alias("arc"), F.concat(F.lit("s"), "file").alias("name"), F.col("content").alias("payload"))
    return AW.build(rows.withColumn("k", F.row_number().over(Window.partitionBy("arc").orderBy("name")) - 1), level=0)


def _archives(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("arc"), k.alias("k"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), F.encode("text", "UTF-8").alias("payload"))
    return AW.build(rows)


# -- coverage ------------------------------------------------------------------------------

_COVERAGE = """count(*) AS entries, count_if(length(msgstr) > 0)::BIGINT AS translated, sum(length(msgid) + 1)::BIGINT AS source_chars, sum(length(msgstr) + 1)::BIGINT AS target_chars,
  sum(length(msgstr) + 1)::DOUBLE / sum(length(msgid) + 1)::DOUBLE AS char_ratio, count_if(length(msgstr) > 0)::DOUBLE / count(*)::DOUBLE * 100 AS progress"""


@query(f"WITH {_PAIRS} SELECT {_COVERAGE} FROM pairs")
def coverage_report(spark, d):
    return K.coverage(_entries(spark, d))


@query(f"WITH {_PAIRS} SELECT conv_id::VARCHAR AS file, {_COVERAGE} FROM pairs GROUP BY conv_id")
def coverage_by_file(spark, d):
    return K.coverage(_entries(spark, d), ["file"])


@query(f"WITH t AS (SELECT string_agg(' ' || {_ASCII.format('text')}, '' ORDER BY conv_id, turn) AS s FROM conversations) SELECT {_TOKENS.format('s')} AS n_tokens FROM t")
def token_count_total(spark, d):
    return K.token_total(_t(spark, d, "conversations").withColumn("text", _ascii("text")), "text", "conv_id", "turn")


@query(f"""WITH {_PAIRS}, a AS (SELECT conv_id::VARCHAR AS file, turn, {_ASCII.format('msgid')} AS msgid, {_ASCII.format('msgstr')} AS msgstr FROM pairs),
j AS (SELECT string_agg(' ' || msgid, '' ORDER BY file, turn) AS s, string_agg(' ' || msgstr, '' ORDER BY file, turn) AS t FROM a)
SELECT {_COVERAGE}, any_value({_TOKENS.format('s')}) AS source_tokens, any_value({_TOKENS.format('t')}) AS target_tokens FROM a, j""")
def program_report(spark, d):
    """The report program over catalogs written as text."""
    entries = _entries(spark, d).withColumns({c: _ascii(c) for c in ("msgid", "msgstr")})
    return programs.report(_catalog_lines(entries))


# -- joins ---------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.lang) AS translated FROM documents d LEFT JOIN labels l USING (doc_id)")
def translate_lookup(spark, d):
    labels = _t(spark, d, "labels").withColumn("said", F.col("quality").cast("string"))
    return K.translated(_t(spark, d, "documents").select("doc_id", "lang"), labels, ["doc_id"], "lang", "said").select("doc_id", "translated")


@query("SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS memory_id FROM documents")
def memory_merge_last_wins(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return docs.join(K.last_wins(docs.select("key", F.col("doc_id").alias("memory_id"), F.col("doc_id").alias("o")), ["key"], "o").drop("o"), "key").select("doc_id", "memory_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, d):
    return K.missing(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def member_semi(spark, d):
    return _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id", "left_semi")


@query("""WITH names AS (SELECT doc_id::VARCHAR || CASE WHEN toxic = 1 THEN '.png' ELSE '.patch.png' END AS name FROM labels UNION SELECT doc_id::VARCHAR || '.patch.png' FROM labels WHERE quality = 1
  UNION SELECT doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '.psd' ELSE '.patch.psd' END FROM labels WHERE doc_id % 7 < 3),
tries AS (SELECT d.doc_id::VARCHAR AS name, s.priority, d.doc_id::VARCHAR || s.suffix AS matched FROM documents d, (VALUES (0, '.psd'), (1, '.patch.psd'), (2, '.png'), (3, '.patch.png')) s(priority, suffix))
SELECT t.name, min(priority) AS priority, min_by(matched, priority) AS matched FROM tries t JOIN names n ON n.name = t.matched GROUP BY t.name""")
def priority_first_match(spark, d):
    labels = _t(spark, d, "labels")
    name = F.col("doc_id").cast("string")
    names = labels.select(F.concat(name, F.when(F.col("toxic") == 1, I.REPLACE).otherwise(I.OVERLAY)).alias("name"))
    names = names.union(labels.where("quality = 1").select(F.concat(name, F.lit(I.OVERLAY))))
    names = names.union(labels.where("doc_id % 7 < 3").select(F.concat(name, F.when(F.col("doc_id") % 3 == 0, ".psd").otherwise(".patch.psd"))))
    return I.choose(_t(spark, d, "documents").select(name.alias("name")), names).select("name", "priority", "matched")


@query("SELECT page_id, lower(regexp_extract(url, '[.]([^./]+)$', 1)) AS ext FROM pages WHERE length(regexp_extract(url, '[.]([^./]+)$', 1)) BETWEEN 2 AND 4")
def extension_filter(spark, d):
    return _t(spark, d, "pages").select("page_id", T.extension(F.col("url")).alias("ext")).where(F.length("ext").between(2, 4))


# -- text functions ------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT doc_id AS file, (unnest(range(1, len(a) + 1)) - 1)::INT AS ln, unnest(a) AS line FROM l""")
def line_explode(spark, d):
    return C.as_lines(_t(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(13), ''), chr(10) || ' ', ' '), ' ' || chr(10), ' '), chr(10), ' ') AS folded FROM documents")
def whitespace_fold(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.fold_lines(F.col("text")).alias("folded"))


@query("SELECT doc_id, replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS escaped, text AS back FROM documents")
def escape_newlines(spark, d):
    c = F.col("text")
    return _t(spark, d, "documents").select("doc_id", T.escape_controls(c).alias("escaped"), T.unescape_controls(T.escape_controls(c, True)).alias("back"))


@query("SELECT conv_id, turn, role AS title, text AS body, '{' || role || '}' || chr(10) || text AS composed, '  ' || role || ' ' AS reshaped FROM conversations")
def split_title_body(spark, d):
    rows = _t(spark, d, "conversations").withColumn("composed", T.message(F.col("role"), F.col("text")))
    reshaped = T.reshape(F.concat(F.lit("  "), "role", F.lit(" ")), T.message_title(F.col("composed")))
    return rows.select("conv_id", "turn", T.message_title(F.col("composed")).alias("title"), T.message_body(F.col("composed")).alias("body"), "composed", reshaped.alias("reshaped"))


@query("SELECT c_custkey, substr(c_name, 3, 4) AS middle, right(c_name, 3) AS tail, left(c_name, 5) AS head FROM customer")
def text_slices(spark, d):
    c = F.col("c_name")
    return _t(spark, d, "customer").select("c_custkey", T.slice_text(c, 2, 4).alias("middle"), T.slice_text(c, -3).alias("tail"), T.slice_text(c, 0, 5).alias("head"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, CASE WHEN contains(p_name, ' ') THEN substr(p_name, position(' ' IN p_name) + 1) ELSE '' END AS rest FROM part")
def split_with_limit(spark, d):
    parts = T.split_limited(F.col("p_name"), " ", 2, fill=True)
    return _t(spark, d, "part").select("p_partkey", parts[0].alias("first"), parts[1].alias("rest"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS kinds FROM f GROUP BY user_id""")
def distinct_comments(spark, d):
    said = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return _t(spark, d, "events").groupBy("user_id").agg(F.array_join(K.each_once(said), ",").alias("kinds"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def range_predicate(spark, d):
    return _t(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT doc_id, replace(replace(text, '“', '"'), '”', '"') AS straight, NOT regexp_matches(replace(replace(text, '“', '"'), '”', '"'), '[^\\x{00}-\\x{FF}]') AS encodable FROM documents""")
def text_normalization(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", T.straight_quotes(F.col("text")).alias("straight"))
    return rows.withColumn("encodable", T.encodable(F.col("straight")))


@query(f"SELECT conv_id, turn, {_TOKENS.format(_ASCII.format('text'))} AS n FROM conversations")
def word_counts(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(T.tokens(_ascii("text"))).cast("long").alias("n"))


# -- ordered state -------------------------------------------------------------------------


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS line FROM events""")
def carry_forward_line(spark, d):
    return S.current_line(_event_ops(spark, d)).select("event_id", F.col("line").cast("long").alias("line"))


@query("""WITH g AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
v AS (SELECT *, list(CASE WHEN event_type IN ('view', 'click') THEN event_id END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS a FROM g),
f AS (SELECT event_id, event_type, list_filter(a, lambda x: x IS NOT NULL) AS s FROM v)
SELECT event_id, s[-1] AS top, s[-2] AS second FROM f WHERE event_type = 'purchase'""")
def session_last_two(spark, d):
    number = lambda c: F.col(c)["arg"]["i"].cast("long")
    return S.stack_top(_event_ops(spark, d), [PUSH_INT], False).select("event_id", number("pair.body").alias("top"), number("pair.title").alias("second"))


@query("""SELECT conv_id AS arc, turn AS k, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text))::INT AS start, strlen(text)::INT AS len FROM conversations""")
def running_offsets(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("arc"), F.col("turn").alias("k"), F.encode("text", "UTF-8").alias("payload"))
    return AW.offsets(rows).select("arc", "k", "start", "len")


@query("""WITH f AS (SELECT user_id AS file, event_type AS s, min(event_id) AS first_ord FROM events GROUP BY ALL)
SELECT file, s, first_ord, (sum(strlen(s) + 1) OVER (PARTITION BY file ORDER BY first_ord) - strlen(s) - 1)::BIGINT AS "offset" FROM f""")
def string_intern_table(spark, d):
    return SW.string_table(_t(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), F.col("event_type").alias("s")))


@query("""WITH h AS (SELECT conv_id, turn, CASE WHEN length(text) <= 132 THEN 22 WHEN length(text) <= 176 THEN 20 WHEN length(text) < 220 THEN 19 ELSE 22 END AS height FROM conversations)
SELECT conv_id, turn, height, coalesce(lag(height) OVER (PARTITION BY conv_id ORDER BY turn), 22) <> height AS changed FROM h""")
def size_change_points(spark, d):
    rows = _t(spark, d, "conversations").withColumn("height", S.font_height(F.length("text")))
    before = F.coalesce(F.lag("height").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(22))
    return rows.select("conv_id", "turn", "height", (before != F.col("height")).alias("changed"))


@query("""WITH RECURSIVE s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS low, floor(epoch(ts))::BIGINT + 86400 AS high, event_id FROM events),
n AS (SELECT *, coalesce((low > max(high) OVER (PARTITION BY user_id ORDER BY low, high, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY low, high, event_id) AS grp FROM n)
SELECT user_id, min(low) AS low, max(high) AS high FROM g GROUP BY user_id, grp""")
def interval_union(spark, d):
    rows = _t(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("low"), (F.unix_timestamp("ts") + 86400).alias("high"))
    return K.merge_intervals(rows, "user_id", "low", "high")


@query("""WITH p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS low, floor(epoch(ts))::BIGINT + 86400 AS high, 1 AS p, 0 AS m FROM events
  UNION ALL SELECT user_id, floor(epoch(ts))::BIGINT + 600, floor(epoch(ts))::BIGINT + 4200, 0, 1 FROM events WHERE event_type = 'click'),
e AS (SELECT user_id, low AS x, p, m FROM p UNION ALL SELECT user_id, high, -p, -m FROM p),
a AS (SELECT user_id, x, sum(p) AS p, sum(m) AS m FROM e GROUP BY user_id, x),
r AS (SELECT user_id, x, lead(x) OVER w AS next, sum(p) OVER w > 0 AND sum(m) OVER w <= 0 AS inside FROM a WINDOW w AS (PARTITION BY user_id ORDER BY x)),
s AS (SELECT user_id, x, next, x IS DISTINCT FROM lag(next) OVER (PARTITION BY user_id ORDER BY x) AS new FROM r WHERE inside AND next IS NOT NULL),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY x) AS grp FROM s)
SELECT user_id, min(x) AS low, max(next) AS high FROM g GROUP BY user_id, grp""")
def interval_difference(spark, d):
    at = F.unix_timestamp("ts")
    rows = _t(spark, d, "events").select("user_id", at.alias("low"), (at + 86400).alias("high"))
    minus = _t(spark, d, "events").where("event_type = 'click'").select("user_id", (at + 600).alias("low"), (at + 4200).alias("high"))
    return K.subtract_intervals(rows, minus, "user_id", "low", "high")


# -- bytes ---------------------------------------------------------------------------------


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(n_name, '')) AS ch FROM nation) WHERE ch <> '' GROUP BY ch")
def symbol_histogram(spark, d):
    return _t(spark, d, "nation").select(F.explode(F.split("n_name", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, (sum(b) % 256)::INT AS total, bit_xor(b)::INT AS parity FROM (SELECT n_nationkey, ascii(unnest(string_split(n_name, ''))) AS b FROM nation) GROUP BY n_nationkey""")
def byte_checksum(spark, d):
    c = B.checksum(F.encode("n_name", "UTF-8"))
    return _t(spark, d, "nation").select("n_nationkey", c["sum"].alias("total"), c["xor"].alias("parity"))


@query("SELECT o_orderkey, (o_custkey // 65536)::BIGINT AS high, (o_custkey % 65536)::BIGINT AS low, (o_custkey // 256 % 256)::BIGINT AS high_byte, (o_custkey % 256)::BIGINT AS low_byte, o_custkey AS back FROM orders")
def words_and_bytes(spark, d):
    c = F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", B.high_word(c).alias("high"), B.low_word(c).alias("low"), B.high_byte(c).alias("high_byte"), B.low_byte(c).alias("low_byte"), B.sint(B.pack_int(c), 0).alias("back"))


@query("""WITH RECURSIVE k AS (SELECT p_partkey, p_size::BIGINT AS v, 0::BIGINT AS key, 0 AS n FROM part
UNION ALL SELECT p_partkey, ((((20021 * (v // 65536) + 346 * v + (20021 * (v % 65536)) // 65536) % 65536) * 65536) + (20021 * (v % 65536)) % 65536 + 1) % 4294967296,
  (20021 * (v // 65536) + 346 * v + (20021 * (v % 65536)) // 65536) % 32768, n + 1 FROM k WHERE n < 4)
SELECT p_partkey, n, key FROM k WHERE n > 0""")
def keystream_values(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.posexplode(B.keystream_values(F.col("p_size"), 4)).alias("n", "key"))
    return rows.select("p_partkey", (F.col("n") + 1).alias("n"), "key")


@query("SELECT p_partkey, p_name AS name, strlen(p_name)::INT AS narrow, (2 * length(p_name))::INT AS wide FROM part")
def charset_conversion(spark, d):
    wide = B.recode(F.encode("p_name", "UTF-8"), "65001", "1200")
    rows = _t(spark, d, "part").select("p_partkey", wide.alias("w"), B.recode(F.encode("p_name", "UTF-8"), "utf-8", "932").alias("n"))
    back = F.decode(B.recode(B.recode(F.col("w"), "1200", "932"), "932", "utf-8"), "UTF-8")
    return rows.select("p_partkey", back.alias("name"), F.octet_length("n").alias("narrow"), F.octet_length("w").alias("wide"))


@query("SELECT page_id, ['DSC', 'CBG', 'RAWIMG', 'PNG', 'PSD', 'RAW'][page_id % 6 + 1] AS kind FROM pages")
def content_sniffing(spark, d):
    from lexloom.codecs import images

    header = F.unhex(F.lit("4000" + "3000" + "18000000" + "00" * 8))
    magics = [F.lit(dsc.MAGIC), F.concat(F.lit(cbg.MAGIC), F.unhex(F.lit("00" * 40))), header, F.lit(images.PNG), F.lit(images.PSD), F.encode(F.lit("<"), "UTF-8")]
    magic = F.get(F.array(*magics), (F.col("page_id") % 6).cast("int"))
    return _t(spark, d, "pages").select("page_id", B.kind(F.concat(magic, F.encode("html", "UTF-8"))).alias("kind"))


@query("""WITH f AS (SELECT event_type AS sym, count(*) AS n FROM events GROUP BY event_type), r AS (SELECT *, row_number() OVER (ORDER BY n, sym) AS place FROM f)
SELECT sym, n, place FROM r WHERE place <= 2""")
def two_lightest(spark, d):
    # symbols of a code, at most 256, and the first two that its tree merges
    counts = _t(spark, d, "events").groupBy(F.col("event_type").alias("sym")).agg(F.count("*").alias("n")).orderBy("sym").collect()
    branches, _ = cbg.tree([r["n"] for r in counts])
    first = branches[min(branches)]
    return spark.createDataFrame([(counts[i]["sym"], counts[i]["n"], p + 1) for p, i in enumerate(first)], "sym string, n long, place long")


@query("SELECT conv_id, turn, text, text AS plain, true AS packed FROM conversations")
def dsc_roundtrip(spark, d):
    data = F.encode("text", "UTF-8")
    rows = B.spread(_t(spark, d, "conversations")).select("conv_id", "turn", B.dsc_compress(data, 9).alias("a"), B.dsc_compress(data, 0).alias("b"))
    back = lambda c: F.decode(B.dsc_decompress(c), "UTF-8")
    return rows.select("conv_id", "turn", back("a").alias("text"), back("b").alias("plain"), (B.is_compressed(F.col("a")) & B.is_compressed(F.col("b"))).alias("packed"))


def _pixels(spark, d):
    # bytes of the texts as images of 8 pixels a row, 24 bits each
    text = F.encode("text", "UTF-8")
    height = F.ceil(F.octet_length(text) / 24).cast("int")
    padded = F.concat(text, F.encode(F.repeat(F.lit(" "), (height * 24 - F.octet_length(text)).cast("int")), "UTF-8"))
    rows = B.spread(_t(spark, d, "conversations")).where("length(text) > 0")
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("path"), F.lit(8).alias("width"), height.alias("height"), F.lit(24).alias("bpp"), F.lit("RAWIMG").alias("codec"), padded.alias("pixels"))


_IMAGE_SQL = "SELECT conv_id || ':' || turn AS path, 8 AS width, ceil(strlen(text) / 24)::INT AS height, rtrim(text) AS text, '{}' AS codec FROM conversations WHERE length(text) > 0"


@query(_IMAGE_SQL.format("CBG"))
def cbg_roundtrip(spark, d):
    got = I.decode(I.encode(_pixels(spark, d), "cbg"))
    return got.select("path", "width", "height", F.rtrim(F.decode("pixels", "UTF-8")).alias("text"), "codec")


@query("SELECT conv_id || ':' || turn AS path, rtrim(text) AS png, (18 + 24 * ceil(strlen(text) / 24))::INT AS tga FROM conversations WHERE length(text) > 0")
def image_export(spark, d):
    pixels = _pixels(spark, d)
    png = I.decode(I.encode(pixels, "png")).select("path", _colors("pixels").alias("png"))
    return png.join(I.encode(pixels, "tga").select("path", F.octet_length("content").alias("tga")), "path")


def _colors(c: str) -> Column:
    """The text in pixels of 32 bits, without their alpha."""
    return F.rtrim(F.decode(F.unhex(F.regexp_replace(F.hex(c), "(.{6})FF", "$1")), "UTF-8"))


@query("SELECT conv_id || ':' || turn AS path, 8 AS width, ceil(strlen(text) / 24)::INT AS height, 32 AS bpp, rtrim(text) AS text FROM conversations WHERE length(text) > 0")
def raw_image_roundtrip(spark, d):
    got = I.decode(I.encode(_pixels(spark, d), "raw", level=0))
    return got.select("path", "width", "height", "bpp", _colors("pixels").alias("text"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_ASCII.format('text')} AS text FROM conversations WHERE length(text) > 0),
p AS (SELECT conv_id, turn, rpad(text, ceil(length(text) / 24)::INT * 24, ' ') AS text FROM t)
SELECT conv_id::VARCHAR AS arc, 'i' || turn AS name, rtrim(CASE turn % 3 WHEN 0 THEN upper(text) WHEN 1 THEN repeat('#', 24) || substr(text, 25) ELSE text END) AS text FROM p""")
def program_images(spark, d):
    """Archives of images, of which some are replaced and others drawn over by files of a catalog."""
    chats = _t(spark, d, "conversations").withColumn("text", _ascii("text")).where("length(text) > 0")
    size = (F.ceil(F.length("text") / 24) * 24).cast("int")
    rows = chats.select("conv_id", "turn", F.rpad("text", size, " ").alias("text"))

    def image(text: Column, form: str) -> DataFrame:
        pixels = rows.select(F.concat_ws(":", "conv_id", "turn").alias("path"), F.lit(8).alias("width"), (F.length(text) / 24).cast("int").alias("height"), F.lit(24).alias("bpp"), F.lit("RAWIMG").alias("codec"), F.encode(text, "UTF-8").alias("pixels"))
        return I.encode(pixels, form)

    number = F.split("path", ":")
    entries = image(F.col("text"), "raw").select(number[0].alias("arc"), number[1].cast("int").alias("k"), F.concat(F.lit("i"), number[1]).alias("name"), F.col("content").alias("payload"))
    # names are alike in all archives, so a catalog belongs to one: here the archive is part of the name
    entries = entries.withColumn("name", F.concat("arc", F.lit("."), F.col("k").cast("string")))
    whole = image(F.upper("text"), "png").where(number[1] % 3 == 0).select(F.concat(number[0], F.lit("."), number[1], F.lit(I.REPLACE)).alias("name"), "content")
    patch = image(F.repeat(F.lit("#"), 24), "png").where(number[1] % 3 == 1).select(F.concat(number[0], F.lit("."), number[1], F.lit(I.OVERLAY)).alias("name"), "content")
    made = AR.entries(programs.translate_image_archive(AW.build(entries), whole.union(patch), level=0))
    got = I.decode(made.select(F.concat_ws("|", "arc", "name").alias("path"), F.col("payload").alias("content")))
    place = F.split("path", r"\|")
    return got.select(place[0].alias("arc"), F.concat(F.lit("i"), F.element_at(F.split(place[1], "[.]"), -1)).alias("name"), _colors("pixels").alias("text"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_ASCII.format('text')} AS text FROM conversations), s AS (SELECT conv_id, turn, left(text, greatest(length(text) - 8, 0)) AS b, right(text, 8) AS tail, length(text) > 8 AS ok FROM t),
w AS (SELECT conv_id, turn, length(b) AS n, reverse(right(b, 4096)) AS w, tail, ok, unnest(range(1, 9)) AS len FROM s),
m AS (SELECT conv_id, turn, len, n, CASE WHEN ok THEN strpos(w, reverse(left(tail, len))) ELSE 0 END AS hit FROM w),
f AS (SELECT conv_id, turn, max(len) FILTER (hit > 0) AS len, max_by(n - hit + 1 - len, len) FILTER (hit > 0) AS pos FROM m GROUP BY ALL)
SELECT conv_id, turn, coalesce(pos, -1)::INT AS pos, coalesce(len, 0)::INT AS len FROM f""")
def lz_longest_match(spark, d):
    """The longest earlier match of each text's last eight bytes in what is before them."""

    @F.pandas_udf("pos int, len int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            data, window = text.encode(), lz_codec.Window()
            window.put(data[:-8])
            out.append(window.longest(data[-8:]) if len(data) > 8 else (-1, 0))
        return pd.DataFrame(out, columns=["pos", "len"])

    return _t(spark, d, "conversations").select("conv_id", "turn", run(_ascii("text")).alias("m")).select("conv_id", "turn", "m.pos", "m.len")


# -- catalogs, scripts, archives -----------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT conv_id::VARCHAR AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS entry_idx, msgid, msgstr FROM pairs")
def po_roundtrip(spark, d):
    lines = C.as_lines(C.joined(C.po_lines(_entries(spark, d)), "entry_idx"))
    return C.parse_po(lines).select("file", "entry_idx", "msgid", "msgstr")


@query("SELECT conv_id::VARCHAR AS file, conv_id || ':' || turn AS ref, turn::INT AS id FROM conversations WHERE role = 'user'")
def po_reference_ids(spark, d):
    lines = C.as_lines(C.joined(C.po_lines(_entries(spark, d)), "entry_idx"))
    return C.po_references(C.parse_po(lines)).select("file", "ref", "id")


@query(f"WITH {_PAIRS} SELECT conv_id::VARCHAR AS file, turn::INT AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS put_idx, msgid AS original, msgstr AS text FROM pairs")
def po_to_keyed(spark, d):
    lines = C.as_lines(C.joined(C.po_lines(_entries(spark, d)), "entry_idx"))
    return C.po_to_keyed(C.parse_po(lines)).select("file", "id", "put_idx", "original", "text")


@query("SELECT conv_id::VARCHAR AS file, turn::INT AS id, regexp_replace(text, '\\s+$', '') AS text FROM conversations")
def sections_roundtrip(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("id"), F.col("turn").alias("put_idx"), "text")
    return C.parse_sections(C.joined(C.sections(rows), "put_idx", "")).select("file", "id", "text")


@query("SELECT conv_id::VARCHAR AS file, turn::INT AS id, regexp_replace(text, '\\s+$', '') AS original, '' AS text FROM conversations")
def tagged_roundtrip(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("id"), F.col("text").alias("original"))
    return C.parse_tagged(C.as_lines(C.joined(C.tagged(rows), "id", ""))).select("file", "id", "original", "text")


@query("SELECT conv_id::VARCHAR AS file, turn::INT AS line, role AS title, text AS body, '{' || role || '}' || chr(10) || text AS \"full\" FROM conversations")
def script_extract(spark, d):
    return S.extract(read_ops(SW.write_ops(_ops(spark, d)))).select("file", "line", "title", "body", "full")


@query("""SELECT conv_id::VARCHAR AS file, turn::INT AS line, coalesce(n.role, c.role) AS title, coalesce(n.text, c.text) AS body FROM conversations c
LEFT JOIN (SELECT conv_id, turn - 1 AS turn, role, text FROM conversations WHERE role = 'assistant') n USING (conv_id, turn)""")
def script_translate(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'assistant'")
    said = rows.select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") - 1).cast("int").alias("id"), T.message(F.col("role"), F.col("text")).alias("text"))
    ops = S.translate(read_ops(SW.write_ops(_ops(spark, d))), said)
    return S.extract(read_ops(SW.write_ops(ops))).select("file", "line", "title", "body")


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n FROM conversations)
SELECT conv_id::VARCHAR AS file, (n * 5 + o)::INT AS op_idx, (n * 40 + [0, 12, 20, 28, 32][o + 1])::BIGINT AS pos,
  [chr(10) || 'conv_' || turn || ':', 'PUSH_STR(' || chr(39) || role || chr(39) || ')', 'PUSH_STR(' || chr(39) || text || chr(39) || ')', 'TEXT_PUT()', 'PUSH_PTR(' || n * 40 || ')'][o + 1] AS shown FROM n, (SELECT unnest(range(0, 5)) AS o)""")
def op_listing(spark, d):
    return S.listing(read_ops(SW.write_ops(_ops(spark, d)))).select("file", "op_idx", "pos", "shown")


@query("""SELECT conv_id::VARCHAR AS file, turn::INT AS line, CASE WHEN role = 'user' AND conv_id::VARCHAR = (SELECT min(conv_id::VARCHAR) FROM conversations) THEN 'USER' ELSE role END AS title FROM conversations""")
def constant_rewrite(spark, d):
    ops = read_ops(SW.write_ops(_ops(spark, d)))
    file = _t(spark, d, "conversations").agg(F.min(F.col("conv_id").cast("string"))).first()[0]
    return S.extract(S.replace_constant(ops, file, "user", "USER")).select("file", "line", "title")


@query("SELECT conv_id::VARCHAR AS file, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 60 + 20)::INT AS target FROM conversations")
def address_relocation(spark, d):
    # each turn's pointer aims at its line op, before which five ops of four bytes get inserted
    ops = read_ops(SW.write_ops(_ops(spark, d)))
    lines = ops.where(F.col("type") == LINE)
    new = lines.select("file", F.col("op_idx").alias("before_idx"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sub_idx"), F.lit(0x22).alias("type"), F.array().cast("array<struct<kind:string,i:int,s:string>>").alias("args"))
    moved = S.relocate(S.insert(ops, new))
    return moved.where(F.col("type") == PUSH_PTR).select("file", F.col("args")[0]["i"].alias("target"))


@query("""WITH h AS (SELECT *, (row_number() OVER w - 1)::INT AS n, replace(replace(replace(replace(regexp_replace(text, '\\s+$', ''), chr(13), ''), chr(10) || ' ', ' '), ' ' || chr(10), ' '), chr(10), ' ') AS said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, CASE WHEN length(said) <= 132 THEN 22 WHEN length(said) <= 176 THEN 20 WHEN length(said) < 220 THEN 19 ELSE 22 END AS height FROM h),
c AS (SELECT *, (height <> coalesce(lag(height) OVER (PARTITION BY conv_id ORDER BY turn), 22))::INT AS c FROM g),
b AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) - c AS before FROM c),
o AS (SELECT *, n * 5 + before * 6 AS first, n * 40 + before * 44 AS base, unnest(CASE WHEN c = 1 THEN range(0, 11) ELSE [0, 7, 8, 9, 10] END) AS o FROM b)
SELECT conv_id::VARCHAR AS file, (first + CASE WHEN c = 1 OR o = 0 THEN o ELSE o - 6 END)::INT AS op_idx,
  (base + [0, 12, 20, 28, 36, 44, 52, 12 + c * 44, 20 + c * 44, 28 + c * 44, 32 + c * 44][o + 1])::BIGINT AS pos,
  [chr(10) || 'conv_' || turn || ':', 'PUSH_INT(2)', 'PUSH_INT(' || height || ')', 'PUSH_INT(' || height || ')', 'PUSH_INT(0)', 'STACK(4)', 'TEXT_SIZE()', 'PUSH_STR(' || chr(39) || said || chr(39) || ')', 'PUSH_STR(' || chr(39) || text || chr(39) || ')', 'TEXT_PUT()', 'PUSH_PTR(' || base || ')'][o + 1] AS shown FROM o""")
def script_patch(spark, d):
    rows = _t(spark, d, "conversations")
    said = rows.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("id"), T.message(F.col("role"), F.col("text")).alias("text"))
    return S.listing(S.patch(read_ops(SW.write_ops(_ops(spark, d))), said))


@query("""SELECT 'a' || conv_id % 3 || '/s' || conv_id AS file, turn::INT AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS put_idx, '{' || role || '}' || chr(10) || text AS original, '' AS text FROM conversations""")
def program_generate_catalogs(spark, d):
    """Archives of scripts to catalogs, read again."""
    arcs = _script_archives(spark, d, F.array(F.concat(F.lit("a"), (F.col("file").cast("long") % 3).cast("string"))))
    files = programs.generate_catalogs(arcs).select(F.concat_ws("/", "arc", "file").alias("file"), "text")
    return C.po_to_keyed(C.parse_po(C.as_lines(files))).select("file", "id", "put_idx", "original", "text")


@query("""SELECT a.arc || '/s' || conv_id AS file, turn::INT AS line, coalesce(n.role, a.mark || c.role) AS title, coalesce(n.text, c.text) AS body FROM conversations c CROSS JOIN (VALUES ('x', ''), ('y', 'y')) a(arc, mark)
LEFT JOIN (SELECT conv_id, turn - 1 AS turn, role, text FROM conversations WHERE role = 'assistant') n USING (conv_id, turn)""")
def program_translate_archive(spark, d):
    """Two archives with scripts of the same names, translated by catalogs and read again."""
    marked = F.transform("args", lambda a: F.struct(a["kind"].alias("kind"), a["i"].alias("i"), F.when(a["s"].isin("user", "assistant", "system"), F.concat(F.lit("y"), a["s"])).otherwise(a["s"]).alias("s")))
    ops = _ops(spark, d)
    arcs = _script_archives(spark, d, F.array(F.lit("x")), ops).union(_script_archives(spark, d, F.array(F.lit("y")), ops.withColumn("args", marked)))
    rows = _t(spark, d, "conversations").where("role = 'assistant'")
    name, line = F.concat(F.lit("s"), F.col("conv_id").cast("string")), (F.col("turn") - 1).cast("int")
    entries = rows.select(name.alias("file"), line.alias("entry_idx"), F.concat(F.lit("line "), line.cast("string")).alias("msgid"), T.message(F.col("role"), F.col("text")).alias("msgstr"), F.array(F.format_string(": %s:%d", name, line)).alias("comments"))
    return S.extract(programs.script_ops(programs.translate_archive(arcs, _catalog_lines(entries)))).select("file", "line", "title", "body")


@query(f"WITH {_PAIRS} SELECT conv_id::VARCHAR AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS entry_idx, msgid, CASE WHEN regexp_replace(msgid, '\\s+$', '') = msgid AND msgid <> '' THEN 'es:' || msgid ELSE msgstr END AS msgstr FROM pairs")
def program_apply_memory(spark, d):
    """Catalogs filled from an older memory in the tagged format."""
    said = lambda tag, mark: F.concat(F.lit(f"\n<{tag}>{mark}"), T.escape_controls(F.col("msgid"), True))
    old = _entries(spark, d).select("file", "entry_idx", F.concat(F.format_string("@%d", "entry_idx"), said("en", ""), said("es", "es:"), F.lit("\n")).alias("chunk"))
    files = programs.apply_memory(_catalog_lines(_entries(spark, d)), C.as_lines(C.joined(old, "entry_idx", "")))
    return C.parse_po(C.as_lines(files)).select("file", "entry_idx", "msgid", "msgstr")


@query("""SELECT 'n' AS arc, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS k, n_name AS name, (sum(strlen(n_name) + 1) OVER (ORDER BY n_nationkey) - strlen(n_name) - 1)::INT AS start, (strlen(n_name) + 1)::INT AS len, n_name || '!' AS text FROM nation
QUALIFY n_name = (SELECT max(n_name) FROM nation)""")
def archive_get(spark, d):
    nations = _t(spark, d, "nation")
    rows = nations.select(F.lit("n").alias("arc"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.encode(F.concat("n_name", F.lit("!")), "UTF-8").alias("payload"))
    name = nations.agg(F.max("n_name")).first()[0]
    return AR.get(AR.entries(AW.build(rows)), name).select("arc", "k", "name", "start", "len", F.decode("payload", "UTF-8").alias("text"))


@query("""SELECT conv_id::VARCHAR AS arc, (row_number() OVER w - 1)::INT AS k, 't' || turn AS name, (sum(strlen(text)) OVER w - strlen(text))::INT AS start, strlen(text)::INT AS len
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def arc_listing(spark, d):
    return AR.entries(_archives(spark, d), payload=False)


@query("SELECT conv_id::VARCHAR AS arc, 't' || turn AS name, text FROM conversations")
def arc_extract(spark, d):
    table = AR.lookup(AR.entries(_archives(spark, d)))
    return table.select("arc", "name", F.decode("payload", "UTF-8").alias("text"))


@query("SELECT conv_id::VARCHAR AS arc, 't' || turn AS name, '[' || text || ']' AS text FROM conversations")
def arc_repack(spark, d):
    wrap = lambda name, payload: F.concat(F.encode(F.lit("["), "UTF-8"), payload, F.encode(F.lit("]"), "UTF-8"))  # noqa: E731, ARG005
    again = AR.entries(AW.repack(AR.entries(_archives(spark, d)), wrap, level=0))
    return again.select("arc", "name", F.decode(B.dsc_decompress("payload"), "UTF-8").alias("text"))


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all executors mount: below spark.checkpoint.dir where that is set; a
    temporary one in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors mount")
    made = os.path.join(named.removeprefix("file://"), f"folder-{uuid.uuid4().hex}") if named else tempfile.mkdtemp(prefix="lexloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def _packed_folder(spark: SparkSession, d: str) -> str:
    """A folder of files, a hidden one among them, packed into the archive beside it; twice, so that
    the first archive is kept as a copy."""
    folder = f"{_folder(spark)}/x.arc.d"
    rows = _t(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("name"), "text")
    AW.write_files(rows, folder, "name", "text")
    AW.write_files(spark.createDataFrame([(".hidden", "no entry")], "name string, text string"), folder, "name", "text")
    AW.pack_folder(spark, folder, -1)
    return AW.pack_folder(spark, folder, 0)


_FOLDER_SQL = "SELECT 'x.arc{}' AS arc, (row_number() OVER (ORDER BY 'c-' || conv_id || '-' || turn) - 1)::INT AS k, 'c-' || conv_id || '-' || turn AS name, text FROM conversations"


@query(_FOLDER_SQL.format(""))
def folder_pack(spark, d):
    """Files of a folder to an archive, whose files are listed and read, in runs."""
    spark.dataSource.register(AR.ArchiveSource)
    found = spark.read.format("arc").load(_packed_folder(spark, d))
    return found.select("arc", "k", "name", F.decode(B.dsc_decompress("payload"), "UTF-8").alias("text"))


@query(_FOLDER_SQL.format(".bak"))
def arc_source(spark, d):
    """The data source `arc` on the copy of the first archive, which is not packed."""
    spark.dataSource.register(AR.ArchiveSource)
    rows = spark.read.format("arc").load(AW.backup_once(_packed_folder(spark, d)))
    return rows.select("arc", "k", "name", F.decode("payload", "UTF-8").alias("text"))
