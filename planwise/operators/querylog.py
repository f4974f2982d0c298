"""Preparing a query log: clauses, tokens, columns touched, frequencies, term vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA, CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.sqltext import CLAUSES
from ..registry import query
from ..sources import adapters
from ..sources.adapters import derived
from ..sources.twins import frame
from .profile import vocabulary

#: A catalog of so many columns is broadcast at the most; beyond, words meet columns in an equi-join.
BROADCAST_COLUMNS = 20_000
#: The words that term vectors leave out.
STOP_WORDS = ["as", "and", "or", "min", "max", "avg", "join", "on", "substr", "between", "count", "sum", "case", "then", "when", "end", "else", "select", "from", "where", "by", "cast", "in"]


@derived
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workload with each text once."""
    return adapters.workload(adapters.query_log(spark, sf_dir))


@query("query_log", "select * from query_log")
def _(spark, sf_dir):
    return adapters.query_log(spark, sf_dir)


@query("dedupe_queries", "select * from workload")
def _(spark, sf_dir):
    return prepared(spark, sf_dir)


MASK_SQL = r"regexp_replace(sql, '\b\d+(\.\d+)?\b', '?', 'g')"


@query("query_templates", f"select {MASK_SQL} as template, count(*) as texts, sum(freq)::bigint as freq, min(query_id) as first_query from workload group by 1")
def _(spark, sf_dir):
    masked = prepared(spark, sf_dir).withColumn("template", sqltext.template(F.col("sql")))
    return masked.groupBy("template").agg(F.count("*").alias("texts"), F.sum("freq").alias("freq"), F.min("query_id").alias("first_query"))


@query(
    "normalize_sql",
    "select query_id, regexp_replace(replace(sql, ' from ', ' from '), ' +', ' ', 'g') as sql from workload",
)
def _(spark, sf_dir):
    """Of statements that were written with capitals, line breaks and a semicolon."""
    wild = prepared(spark, sf_dir).withColumn("sql", F.concat(F.regexp_replace(F.regexp_replace("sql", "select ", "SELECT\n"), " from ", "  From "), F.lit(";\n")))
    return wild.select("query_id", sqltext.normalize(F.col("sql")).alias("sql"))


def clause_rows(queries: DataFrame) -> DataFrame:
    """query_id, clause, ord, text: one row for each clause present."""
    parts = F.array(*[F.struct(F.lit(c).alias("clause"), F.lit(i).alias("ord"), sqltext.clause(F.col("sql"), c).alias("text")) for i, c in enumerate(CLAUSES)])
    return queries.select("query_id", F.explode(parts).alias("_c")).select("query_id", "_c.*").where("text != ''")


frame("clause_rows", " union all ".join(f"select query_id, '{c}' as clause, {i} as ord, text from (select query_id, regexp_extract(sql, '{'^select ' if c == 'select' else f' {c} '}(.*?)(?:{sqltext.ENDS[c]})', 1) as text from workload) where text != ''" for i, c in enumerate(CLAUSES)))
frame(
    "shapes",
    "select query_id, any_value(freq) as freq, any_value(n) as n, case when s = '' then 's' when s = 'w' then 'n' else s end as shape from (select query_id, freq, n, coalesce(string_agg(case clause when 'where' then 'w' when 'group by' then 'g' when 'having' then 'h' when 'order by' then 'o' else '' end, '' order by ord), '') as s from workload left join clause_rows using (query_id) group by query_id, freq, n) group by query_id, s",
)


@query("split_clauses", "select query_id, clause, ord, text from clause_rows")
def _(spark, sf_dir):
    return clause_rows(prepared(spark, sf_dir))


@query("shape_counts", "select shape, count(*) as queries, sum(freq)::bigint as freq from shapes group by shape")
def _(spark, sf_dir):
    return prepared(spark, sf_dir).groupBy(sqltext.shape(F.col("sql")).alias("shape")).agg(F.count("*").alias("queries"), F.sum("freq").alias("freq"))


def token_rows(queries: DataFrame) -> DataFrame:
    """query_id, clause, ord, pos, token: tokens of each clause in order; no shuffle."""
    return clause_rows(queries).select("query_id", "clause", "ord", F.posexplode(sqltext.tokens(F.col("text"))).alias("pos", "token"))


frame("token_rows", r"select query_id, clause, ord, (unnest(range(len(t))))::int as pos, unnest(t) as token from (select query_id, clause, ord, list_filter(regexp_extract_all(text, '(<=|>=|<>|!=|[=<>(),*;]|[^\s=<>(),*;!]+)', 1), lambda x: x not in (',', ';')) as t from clause_rows)")


@query("tokenize", "select * from token_rows")
def _(spark, sf_dir):
    return token_rows(prepared(spark, sf_dir))


def typed_tokens(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds type. Neighbours come from a window over one clause; the catalog is broadcast where it is small."""
    at = Window.partitionBy("query_id", "ord").orderBy("pos")
    names = catalog.select(F.col("col").alias("_name"), F.lit(False).alias("_table")).union(catalog.select("tab", F.lit(True))).distinct()
    if names.limit(BROADCAST_COLUMNS + 1).count() <= BROADCAST_COLUMNS:
        names = F.broadcast(names)
    near = {n: F.coalesce(F.lower(f("token", k).over(at)), F.lit("")) for n, f, k in (("_b", F.lag, 1), ("_b2", F.lag, 2), ("_a", F.lead, 1))}
    known = tokens.withColumns(near).join(names, F.lower("token") == F.col("_name"), "left")
    role = sqltext.token_role(F.col("clause"), F.col("token"), F.col("_b"), F.col("_b2"), F.col("_a"), F.coalesce("_table", F.lit(False)), F.coalesce(~F.col("_table"), F.lit(False)))
    return known.select("query_id", "clause", "ord", "pos", "token", role.alias("type"))


def word_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


frame(
    "typed_tokens",
    f"""
    select query_id, clause, ord, pos, token, case
        when token in ({word_list(sqltext.JOINING)}) then 'join' when token in ({word_list(sqltext.CONJUNCTIONS)}) then 'conjunction' when token in ({word_list(sqltext.OPERATORS)}) then 'operator'
        when token in ({word_list(sqltext.AGGREGATES)}) and a = '(' then 'aggregator' when token in ('(', ')', '*') then 'parenthesis' when token in ('asc', 'desc') then 'order_by_key'
        when is_table and b = 'join' then '#join_table' when is_table and clause = 'from' then '#table'
        when is_col and b = '(' then clause || '#aggregate_column' when is_col and clause = 'from' then 'from#join_column' when is_col then clause || '#column'
        when b in ({word_list(sqltext.OPERATORS)}) and clause = 'having' then '#aggregate_value'
        when b in ({word_list(sqltext.OPERATORS)}) then case when b2 in ({word_list(sqltext.AGGREGATES)}) or b2 = ')' then '#aggregate_value' else b2 || '#value' end
        when b = 'like' then '#like_value' else 'other' end as type
    from (select *, coalesce(lag(token) over w, '') as b, coalesce(lag(token, 2) over w, '') as b2, coalesce(lead(token) over w, '') as a,
        token in (select tab from catalog) as is_table, token in (select col from catalog) as is_col from token_rows window w as (partition by query_id, ord order by pos))""",
)


@derived
def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_tokens(token_rows(prepared(spark, sf_dir)), adapters.catalog(spark, sf_dir))


@query("type_tokens", "select * from typed_tokens")
def _(spark, sf_dir):
    return typed(spark, sf_dir)


def encode_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds word_id: a value's by its column, any other word's by itself; 1 where unknown."""
    words = vocab.select(F.when(F.col("kind") == "value", F.concat("owner", F.lit("#_#"), "word")).otherwise(F.col("word")).alias("_word"), "word_id").groupBy("_word").agg(F.min("word_id").alias("word_id"))
    value = F.col("type").endswith("#value") & ~F.col("type").startswith("#")
    number = F.coalesce(F.col("token").try_cast("decimal(24,4)").cast("string"), F.col("token"))
    key = F.when(value, F.concat(F.regexp_extract("type", "^(.*)#value$", 1), F.lit("#_#"), number)).when(F.col("token") == "<>", "!=").otherwise(F.col("token"))
    return tokens.withColumn("_key", key).join(words, F.col("_key") == F.col("_word"), "left").select("query_id", "clause", "ord", "pos", "token", "type", F.coalesce("word_id", F.lit(1)).alias("word_id"))


frame(
    "encoded",
    """
    select t.query_id, t.clause, t.ord, t.pos, t.token, t.type, coalesce(v.word_id, 1) as word_id from (
      select *, case when type like '%#value' and type not like '#%' then regexp_extract(type, '^(.*)#value$', 1) || '#_#' || coalesce(try_cast(token as decimal(24,4))::varchar, token) when token = '<>' then '!=' else token end as key from typed_tokens) t
    left join (select case when kind = 'value' then owner || '#_#' || word else word end as word, min(word_id) as word_id from vocab group by 1) v on t.key = v.word""",
)


@query("encode_tokens", "select query_id, clause, ord, pos, token, type, word_id from encoded")
def _(spark, sf_dir):
    return encode_tokens(typed(spark, sf_dir), vocabulary(spark, sf_dir))


def decode_tokens(tokens: DataFrame) -> DataFrame:
    """query_id, sql: clauses put together; OR becomes AND and != becomes =, text literals are quoted, adjacent columns get commas."""
    at = Window.partitionBy("query_id", "ord").orderBy("pos")
    plain = F.col("token")
    word = F.when(F.lower(plain) == "or", "and").when(plain.isin("!=", "<>"), "=").when(F.col("type").endswith("value") & plain.try_cast("double").isNull(), F.concat(F.lit("'"), plain, F.lit("'"))).otherwise(plain)
    comma = (F.col("type").endswith("column") & F.lag("type").over(at).endswith("column")) | ((F.col("type") == "aggregator") & F.lag("type").over(at).endswith("column"))
    written = tokens.withColumn("_w", F.concat(F.when(comma, ", ").when(F.col("pos") > 0, " ").otherwise(""), word))
    clauses = written.groupBy("query_id", "ord", "clause").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_w"))), lambda x: x["_w"]), "").alias("_t"))
    return clauses.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat("clause", F.lit(" "), "_t").alias("_c")))), lambda x: x["_c"]), " ").alias("sql"))


@query(
    "decode_tokens",
    """
select query_id, string_agg(clause || ' ' || t, ' ' order by ord) as sql from (
  select query_id, ord, clause, string_agg(case when comma then ', ' when pos > 0 then ' ' else '' end || word, '' order by pos) as t from (
    select *, case when token = 'or' then 'and' when token in ('!=', '<>') then '=' when type like '%value' and try_cast(token as double) is null then '''' || token || '''' else token end as word,
      coalesce((type like '%column' or type = 'aggregator') and lag(type) over (partition by query_id, ord order by pos) like '%column', false) as comma from typed_tokens)
  group by query_id, ord, clause) group by query_id""",
)
def _(spark, sf_dir):
    return decode_tokens(typed(spark, sf_dir))


#: A run of characters that names are made of.
NAME_RUN = "[a-z0-9_.]+"


def columns_by_parts(text: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, tab, col: names within _sql, for a catalog of any size. A name of one run of characters lies within one run of the text, so it equals a part of it; other names are looked for one by one."""
    keyed = names.withColumn("_key", F.when(F.col("ambiguous"), F.concat("tab", F.lit("."), "col")).otherwise(F.col("col")))
    plain = F.col("_key").rlike(f"^{NAME_RUN}$") & F.col("tab").rlike(f"^{NAME_RUN}$")
    runs = text.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("_sql", F.lit(f"({NAME_RUN})"), 1))).alias("_run"))
    size = F.length("_run")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring("_run", i, n))))
    parts = runs.select("_run").distinct().withColumn("_part", F.explode(F.array_distinct(cut)))
    words = keyed.where(plain).select(F.explode(F.array("_key", "tab")).alias("_part")).distinct()
    here = runs.join(parts.join(words, "_part"), "_run").select("query_id", "_part").distinct()
    found = here.join(keyed.where(plain), F.col("_part") == F.col("_key")).select("query_id", "tab", "col")
    whole = found.join(here.withColumnRenamed("_part", "tab"), ["query_id", "tab"], "left_semi").select("query_id", "tab", "col")
    odd = text.join(keyed.where(~plain), F.contains("_sql", "tab") & F.contains("_sql", "_key")).select("query_id", "tab", "col")
    return whole.union(odd)


def indexable_columns(queries: DataFrame, catalog: DataFrame, whole_words: bool = False) -> DataFrame:
    """query_id, tab, col: a column counts where its name and its table's are in the text; a name of several tables needs `table.column`.

    The catalog is broadcast up to BROADCAST_COLUMNS columns; beyond, parts of the texts' words join it by equality, with the same rows.
    whole_words matches words, by an equi-join of any size.
    """
    many = catalog.groupBy("col").agg((F.count("*") > 1).alias("ambiguous"))
    names = catalog.select("tab", "col").join(many, "col")
    text = queries.select("query_id", F.lower("sql").alias("_sql"))
    if whole_words:
        words = text.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("_sql", F.lit(r"([a-z_][a-z_0-9.]*)"), 1))).alias("_word"))
        keyed = names.withColumn("_key", F.when(F.col("ambiguous"), F.concat("tab", F.lit("."), "col")).otherwise(F.col("col")))
        columns = words.join(keyed, F.col("_word") == F.col("_key"))
        tables = words.select(F.col("query_id"), F.col("_word").alias("tab"))
        return columns.select("query_id", "tab", "col").distinct().join(tables, ["query_id", "tab"], "left_semi")
    if names.limit(BROADCAST_COLUMNS + 1).count() > BROADCAST_COLUMNS:
        return columns_by_parts(text, names)
    qualified = F.when(F.col("ambiguous"), F.contains("_sql", F.concat("tab", F.lit("."), "col"))).otherwise(F.contains("_sql", "col"))
    return text.join(F.broadcast(names), F.contains("_sql", "tab") & qualified).select("query_id", "tab", "col")


frame("query_column", "select query_id, tab, col from workload join (select tab, col, count(*) over (partition by col) > 1 as ambiguous from catalog) c on contains(lower(sql), tab) and case when ambiguous then contains(lower(sql), tab || '.' || col) else contains(lower(sql), col) end")


@derived
def columns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexable_columns(prepared(spark, sf_dir), adapters.catalog(spark, sf_dir))


@query("indexable_columns", "select * from query_column")
def _(spark, sf_dir):
    return columns_of(spark, sf_dir)


@query("indexable_columns_words", r"select distinct query_id, tab, col from (select query_id, unnest(regexp_extract_all(lower(sql), '([a-z_][a-z_0-9.]*)', 1)) as word, sql from workload) join catalog on word = col where regexp_matches(sql, '\b' || tab || '\b')")
def _(spark, sf_dir):
    return indexable_columns(prepared(spark, sf_dir), adapters.catalog(spark, sf_dir), whole_words=True)


ROLE = {"where": "predicates", "from": "predicates", "select": "payload", "having": "payload", "group by": "group_by", "order by": "order_by"}


def clause_columns(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, role, tab, col, pos: predicates (join columns count as such), payload, group_by, order_by; pos is the first place."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    columns = tokens.where(F.col("type").endswith("column"))
    return columns.join(F.broadcast(catalog.select("tab", "col")), F.col("token") == F.col("col")).groupBy("query_id", role[F.col("clause")].alias("role"), "tab", "col").agg(F.min(F.col("ord") * 1000 + F.col("pos")).alias("pos"))


frame(
    "clause_column",
    f"select query_id, case clause {' '.join(f"when '{c}' then '{r}'" for c, r in ROLE.items())} end as role, tab, col, min(ord * 1000 + pos) as pos from typed_tokens join catalog on token = col where typed_tokens.type like '%column' group by all",
)


@derived
def roles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clause_columns(typed(spark, sf_dir), adapters.catalog(spark, sf_dir))


@query("clause_columns", "select query_id, role, tab, string_agg(col, ',' order by col) as cols from clause_column group by query_id, role, tab")
def _(spark, sf_dir):
    return roles_of(spark, sf_dir).groupBy("query_id", "role", "tab").agg(F.array_join(F.sort_array(F.collect_set("col")), ",").alias("cols"))


def assign_frequency(queries: DataFrame, given: str | None = None, mode: str = "keyed", top: int = 1000) -> DataFrame:
    """freq: what is given, else one (mode `one`), or a number from 1 to top that the id determines."""
    made = F.lit(1).cast("long") if mode == "one" else 1 + (F.col("query_id") * 7919) % top
    return queries.withColumn("freq", F.coalesce(F.col(given), made) if given else made)


@query("assign_frequency", "select query_id, coalesce(case when query_id % 3 = 0 then freq end, 1 + (query_id * 7919) % 1000) as freq from workload")
def _(spark, sf_dir):
    some = prepared(spark, sf_dir).withColumn("noted", F.when(F.col("query_id") % 3 == 0, F.col("freq")))
    return assign_frequency(some, "noted").select("query_id", "freq")


def workload_columns(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """column_id, tab, col: the columns a workload touches, numbered in the catalog's order."""
    used = catalog.join(columns.select("tab", "col").distinct(), ["tab", "col"], "left_semi")
    return used.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tab", "ordinal")) - 1).alias("column_id"), "tab", "col")  # one catalog's rows


frame("workload_column", "select (row_number() over (order by tab, ordinal) - 1)::int as column_id, tab, col from catalog semi join query_column using (tab, col)")


@query("workload_columns", "select * from workload_column")
def _(spark, sf_dir):
    return workload_columns(columns_of(spark, sf_dir), adapters.catalog(spark, sf_dir))


def filter_small_tables(columns: DataFrame, catalog: DataFrame, least: int) -> DataFrame:
    return columns.join(F.broadcast(catalog.where(F.col("rows") > least).select("tab").distinct()), "tab", "left_semi").select(*columns.columns)


@query("filter_small_tables", "select query_id, tab, col from query_column semi join (select distinct tab from catalog where rows > 1000) using (tab)")
def _(spark, sf_dir):
    return filter_small_tables(columns_of(spark, sf_dir), adapters.catalog(spark, sf_dir), 1000)


@query("workload_matrix", "select query_id, list(column_id order by column_id)::varchar as columns, count(*) as n from query_column join workload_column using (tab, col) group by query_id")
def _(spark, sf_dir):
    """Sparse rows: the ids of the ones."""
    columns = columns_of(spark, sf_dir)
    ids = workload_columns(columns, adapters.catalog(spark, sf_dir))
    rows = columns.join(F.broadcast(ids), ["tab", "col"]).groupBy("query_id").agg(F.sort_array(F.collect_list("column_id")).alias("c"), F.count("*").alias("n"))
    return rows.select("query_id", F.concat(F.lit("["), F.array_join(F.col("c").cast("array<string>"), ", "), F.lit("]")).alias("columns"), "n")


@query("access_vector", "select tab, col, sum(freq)::bigint as freq from query_column join workload using (query_id) group by tab, col")
def _(spark, sf_dir):
    return columns_of(spark, sf_dir).join(prepared(spark, sf_dir).select("query_id", "freq"), "query_id").groupBy("tab", "col").agg(F.sum("freq").alias("freq"))


def terms(queries: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """query_id, term, n: lower-case words that are no stop words."""
    words = queries.select("query_id", F.explode(F.regexp_extract_all(F.lower("sql"), F.lit(r"([a-z_0-9.]+)"), 1)).alias("term"))
    return words.where(~F.col("term").isin(*stop)).groupBy("query_id", "term").agg(F.count("*").alias("n"))


frame("terms", f"select query_id, term, count(*) as n from (select query_id, unnest(regexp_extract_all(lower(sql), '([a-z_0-9.]+)', 1)) as term from workload) where term not in ({word_list(STOP_WORDS)}) group by query_id, term")


@query("query_bow", "select * from terms")
def _(spark, sf_dir):
    return terms(prepared(spark, sf_dir))


def tfidf(counts: DataFrame, key: str = "query_id") -> DataFrame:
    """key, term, weight: n * log2(N / df), each document's vector of length one; terms of all documents weigh nothing and are left out."""
    size = counts.select(key).distinct().agg(F.count("*").alias("_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("_df"))
    raw = counts.join(df, "term").join(F.broadcast(size)).withColumn("_w", F.col("n") * F.log2(F.col("_docs") / F.col("_df"))).where("_w > 0")
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, key).select(key, "term", F.round(F.col("_w") / F.col("_norm"), 6).alias("weight"))


def tfidf_sql(counts: str, key: str = "query_id") -> str:
    return f"select {key}, term, round(w / sqrt(sum(w * w) over (partition by {key})), 6) as weight from (select {key}, term, n * log2((select count(distinct {key}) from {counts}) / count(*) over (partition by term)) as w from {counts}) where w > 0"


@query("query_tfidf", tfidf_sql("terms"))
def _(spark, sf_dir):
    return tfidf(terms(prepared(spark, sf_dir)))


def signed_rows(rows: DataFrame, key: str, k: int) -> DataFrame:
    """key, vec: components rounded, each with the sign that makes its largest entry positive."""
    tops = rows.agg(*[F.max_by(F.element_at("vec", i + 1), F.struct(F.abs(F.round(F.element_at("vec", i + 1), 6)), F.col(key))).alias(f"_t{i}") for i in range(k)])
    signs = F.array(*[F.when(F.col(f"_t{i}") < 0, -1.0).otherwise(1.0) for i in range(k)])
    return rows.join(F.broadcast(tops)).select(key, F.zip_with("vec", signs, lambda v, s: F.round(v * s, 6)).alias("vec"))


def bag_vectors(queries: DataFrame):
    words = RegexTokenizer(inputCol="sql", outputCol="words", pattern=r"[^a-z_0-9.]+").transform(queries)
    return CountVectorizer(inputCol="words", outputCol="bag", vocabSize=2048).fit(words).transform(words).select("query_id", "bag")


def query_pca(queries: DataFrame, k: int = 4) -> DataFrame:
    bags = bag_vectors(queries)
    reduced = PCA(k=k, inputCol="bag", outputCol="pc").fit(bags).transform(bags)
    return signed_rows(reduced.select("query_id", vector_to_array("pc").alias("vec")), "query_id", k)


@query("query_pca")
def _(spark, sf_dir):
    return query_pca(prepared(spark, sf_dir))


def term_space(weights: DataFrame, key: str, k: int) -> DataFrame:
    """key, vec: rows of weights in the space of the k largest singular vectors. weights: key, term, weight; at most 2048 terms, the most frequent."""
    top = weights.groupBy("term").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "term").limit(2048)
    ids = top.select("term", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).alias("_i"))
    size = ids.count()
    rows = weights.join(F.broadcast(ids), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "weight"))).alias("_v"))
    vectors = rows.rdd.map(lambda r: OldVectors.sparse(size, [x[0] for x in r["_v"]], [float(x[1]) for x in r["_v"]]))
    k = min(k, size)
    found = RowMatrix(vectors, numCols=size).computeSVD(k).V.toArray()
    axes = F.array(*[F.array(*[F.lit(float(x)) for x in found[:, j]]) for j in range(k)])
    spaces = weights.sparkSession.range(1).select(axes.alias("_axes"))
    placed = rows.join(F.broadcast(spaces)).select(key, F.transform("_axes", lambda a: F.aggregate("_v", F.lit(0.0), lambda s, x: s + x["weight"] * F.element_at(a, x["_i"] + 1))).alias("vec"))
    return signed_rows(placed, key, k)


@query("query_lsi")
def _(spark, sf_dir):
    return term_space(tfidf(terms(prepared(spark, sf_dir))), "query_id", 4)
