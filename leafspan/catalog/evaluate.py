"""Answer scoring over ``conversations``, ``part``, ``documents`` with ``labels``, and HTML tables over ``part``."""

from leafspan.catalog.base import query, table
from leafspan.functions import scoring, tables
from leafspan.functions import text as T
from leafspan.functions.lists import list_exact, list_f1
from leafspan.functions.text import PUNCTUATION, WHITESPACE
from leafspan.operators import evaluate
from pyspark.sql import functions as F

SQL_PUNCTUATION = PUNCTUATION.replace("'", "''")


def normalised(column: str) -> str:
    """SQL list of the normalised tokens of a column."""
    return (
        f"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '{SQL_PUNCTUATION}', '', 'g'), '{WHITESPACE}+'), "
        "lambda x: x NOT IN ('', 'a', 'an', 'the'))"
    )


TURNS = f"""turns AS (
  SELECT a.conv_id, a.turn, {normalised('b.text')} AS ours, {normalised('a.text')} AS theirs, b.text AS predicted, a.text AS gold
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"""


def turns(spark, sf):
    talk = table(spark, sf, "conversations", spread=True)
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    told = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("predicted"))
    return asked.join(told, ["conv_id", "turn"])


@query("answer_normalise", f"WITH {TURNS} SELECT conv_id, turn, coalesce(list_aggregate(ours, 'string_agg', ' '), '') AS answer FROM turns")
def answer_normalise(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", scoring.normalise_answer(F.col("predicted")).alias("answer"))


@query(
    "token_f1",
    f"""WITH {TURNS},
one AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(ours) AS t FROM turns) GROUP BY ALL),
two AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(theirs) AS t FROM turns) GROUP BY ALL),
same AS (SELECT conv_id, turn, sum(least(one.n, two.n)) AS s FROM one JOIN two USING (conv_id, turn, t) GROUP BY ALL)
SELECT t.conv_id, t.turn, round(coalesce(2.0 * s / (len(ours) + len(theirs)), 0), 6) AS f1 FROM turns t LEFT JOIN same USING (conv_id, turn)""",
)
def token_f1(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.round(scoring.token_f1(F.col("predicted"), F.col("gold")), 6).alias("f1"))


@query(
    "evidence_f1",
    f"""WITH {TURNS},
sets AS (SELECT conv_id, turn, list_distinct(string_split(predicted, ' ')) AS p, list_distinct(string_split(gold, ' ')) AS g FROM turns)
SELECT conv_id, turn, round(2.0 * len(list_intersect(p, g)) / (len(p) + len(g)), 6) AS f1 FROM sets""",
)
def evidence_f1(spark, sf):
    parts = lambda c: F.array_distinct(F.split(c, " "))
    return turns(spark, sf).select(
        "conv_id", "turn", F.round(scoring.evidence_f1(parts("predicted"), parts("gold")), 6).alias("f1")
    )


@query(
    "containment_accuracy",
    f"""WITH {TURNS}
SELECT conv_id, turn, CAST(contains(coalesce(list_aggregate(ours, 'string_agg', ' '), ''), theirs[1]) AS INTEGER) AS accuracy
FROM turns WHERE len(theirs) > 0""",
)
def containment_accuracy(spark, sf):
    gold = F.get(T.words(scoring.normalise_answer(F.col("gold"))), F.lit(0))
    return turns(spark, sf).withColumn("first", gold).filter("first IS NOT NULL").select(
        "conv_id", "turn", scoring.containment(F.col("predicted"), F.array("first")).alias("accuracy")
    )


@query(
    "best_over_references",
    f"""WITH {TURNS},
golds AS (
  SELECT t.conv_id, t.turn, t.ours, {normalised("x.line")} AS theirs
  FROM turns t, (SELECT conv_id, turn, unnest(string_split(gold, chr(10))) AS line FROM turns) x WHERE x.conv_id = t.conv_id AND x.turn = t.turn),
numbered AS (SELECT *, row_number() OVER () AS g FROM golds),
one AS (SELECT g, t, count(*) AS n FROM (SELECT g, unnest(ours) AS t FROM numbered) GROUP BY ALL),
two AS (SELECT g, t, count(*) AS n FROM (SELECT g, unnest(theirs) AS t FROM numbered) GROUP BY ALL),
same AS (SELECT g, sum(least(one.n, two.n)) AS s FROM one JOIN two USING (g, t) GROUP BY ALL)
SELECT conv_id * 1000 + turn AS answer_id, round(max(coalesce(2.0 * s / (len(ours) + len(theirs)), 0)), 6) AS f1,
  CAST(max(contains(coalesce(list_aggregate(ours, 'string_agg', ' '), ''), coalesce(list_aggregate(theirs, 'string_agg', ' '), ''))) AS INTEGER) AS accuracy
FROM numbered LEFT JOIN same USING (g) GROUP BY ALL""",
)
def best_over_references(spark, sf):
    rows = turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "predicted", F.split("gold", "\n").alias("golds")
    )
    return evaluate.best_over_references(rows, "answer_id", "predicted", "golds").withColumn("f1", F.round("f1", 6))


PAIRS = """pairs AS (
  SELECT p_partkey, lower(p_name) AS gold, lower(replace(p_name, 'r', 'rr')) AS predicted FROM part)"""


@query(
    "anls",
    f"""WITH {PAIRS},
valued AS (SELECT *, 1 - levenshtein(gold, predicted) / CAST(greatest(length(gold), length(predicted)) AS DOUBLE) AS v FROM pairs)
SELECT p_partkey, round(CASE WHEN v <= 0.5 THEN 0 ELSE v END, 6) AS anls FROM valued""",
)
def anls(spark, sf):
    part = table(spark, sf, "part")
    gold, predicted = F.lower("p_name"), F.lower(F.replace("p_name", F.lit("r"), F.lit("rr")))
    return part.select("p_partkey", F.round(scoring.anls(gold, predicted), 6).alias("anls"))


@query(
    "typed_score",
    """WITH asked AS (
  SELECT p_partkey, p_partkey % 4 AS kind, p_size, p_retailprice, lower(p_name) AS name, lower(replace(p_name, 'r', 'rr')) AS other,
         p_type, p_brand, p_partkey FROM part),
valued AS (SELECT *, 1 - levenshtein(name, other) / CAST(greatest(length(name), length(other)) AS DOUBLE) AS v FROM asked)
SELECT p_partkey, round(CASE kind
  WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END
  WHEN 1 THEN CASE WHEN p_size % 4 <= 1 THEN 1 ELSE 0 END
  WHEN 2 THEN CASE WHEN v <= 0.5 THEN 0 ELSE v END
  ELSE CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END END, 6) AS score FROM valued""",
)
def typed_score(spark, sf):
    part = table(spark, sf, "part")
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    price = F.col("p_retailprice")
    text = lambda c: c.cast("string")
    items = lambda *cs: F.concat(F.lit("['"), cs[0], F.lit("', \""), cs[1], F.lit('"]'))
    gold = F.when(kind == 0, text(size)).when(kind == 1, text(price)).when(kind == 2, F.col("p_name")).otherwise(
        items(F.col("p_type"), F.col("p_brand"))
    )
    predicted = (
        F.when(kind == 0, F.concat(text(size + size % 2), F.lit(".0")))
        .when(kind == 1, F.concat(F.lit("$"), text(price * (1 + 0.007 * (size % 4))), F.lit("%")))
        .when(kind == 2, F.replace("p_name", F.lit("r"), F.lit("rr")))
        .when(size % 3 == 0, F.col("p_type")).otherwise(items(F.col("p_brand"), F.col("p_type")))
    )
    name = F.element_at(F.array(F.lit("Int"), F.lit("Float"), F.lit("Str"), F.lit("List")), (kind + 1).cast("int"))
    return part.select("p_partkey", F.round(scoring.typed_score(gold, predicted, name), 6).alias("score"))


@query(
    "clean_answer",
    """SELECT p_partkey, lower(p_name) AS answer, p_partkey % 2 = 0 AS exact FROM part""",
)
def clean_answer(spark, sf):
    part = table(spark, sf, "part")
    decorated = F.concat(F.lit("$"), F.upper("p_name"), F.lit(" (of "), F.col("p_brand"), F.lit(") %"))
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_size").cast("string")))
    return part.select(
        "p_partkey", scoring.clean_answer(decorated).alias("answer"),
        scoring.wants_exact_match(F.coalesce(code, F.col("p_type"))).alias("exact"),
    )


SAMPLES = """samples AS (
  SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'Not answerable' ELSE 'known' END AS answer,
         CASE WHEN l.quality = 0 THEN 'Not answerable' ELSE 'known' END AS pred,
         CASE WHEN l.quality <> l.toxic THEN 1.0 ELSE 0.25 END AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def samples(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    flag = lambda c, v: F.when(F.col(c) == v, "Not answerable").otherwise("known")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", flag("toxic", 1).alias("answer"), flag("quality", 0).alias("pred"),
        F.when(F.col("quality") != F.col("toxic"), 1.0).otherwise(0.25).alias("score"),
    )


@query(
    "accuracy_and_f1",
    f"""WITH {SAMPLES},
sums AS (
  SELECT lang, avg(score) AS accuracy, sum(CASE WHEN answer <> 'Not answerable' THEN score ELSE 0 END) AS hits,
         count_if(answer <> 'Not answerable') AS a, count_if(pred <> 'Not answerable') AS p FROM samples GROUP BY lang)
SELECT lang, round(accuracy, 6) AS accuracy,
  round(CASE WHEN a > 0 AND p > 0 AND hits > 0 THEN 2 * (hits / a) * (hits / p) / (hits / a + hits / p) ELSE 0 END, 6) AS f1 FROM sums""",
)
def accuracy_and_f1(spark, sf):
    scored = evaluate.accuracy_and_f1(samples(spark, sf), ["lang"])
    return scored.select("lang", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query(
    "mean_scores",
    f"""WITH {SAMPLES}
SELECT lang, count(*) AS n_all, CAST(count_if(answer <> 'Not answerable') AS BIGINT) AS n_answerable, round(avg(score), 6) AS score_all,
  round(avg(CASE WHEN answer <> 'Not answerable' THEN score END), 6) AS score_answerable FROM samples GROUP BY lang""",
)
def mean_scores(spark, sf):
    return evaluate.mean_scores(samples(spark, sf), ["score"], ["lang"])


@query(
    "structured_references",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_returnflag = 'R' THEN 'Not answerable' WHEN l_linestatus = 'F' THEN 'a, ' || l_returnflag
       WHEN l_tax > 0.04 THEN 'tax' WHEN l_discount > 0.05 THEN 'Yes' ELSE 'No' END AS reference, 1 AS n_evidence
FROM lineitem""",
)
def structured_references(spark, sf):
    answer = F.struct(
        (F.col("l_returnflag") == "R").alias("unanswerable"),
        F.when(F.col("l_linestatus") == "F", F.array(F.lit("a"), F.col("l_returnflag")))
        .otherwise(F.array().cast("array<string>")).alias("extractive_spans"),
        F.when(F.col("l_tax") > 0.04, "tax").otherwise("").alias("free_form_answer"),
        (F.col("l_discount") > 0.05).alias("yes_no"),
        F.array(F.lit("FLOAT SELECTED: Table 1"), F.lit("paragraph")).alias("evidence"),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.get(scoring.references(F.array(answer)), F.lit(0)).alias("reference"),
        F.size(F.get(scoring.text_evidence(F.array(answer)), F.lit(0))).alias("n_evidence"),
    )


@query(
    "judgement_parse",
    """SELECT o_orderkey, o_orderpriority AS extracted_results, CASE WHEN o_orderstatus = 'F' THEN 'Failed to extract' ELSE 'String' END AS format,
  CAST(o_custkey % 2 AS VARCHAR) AS score FROM orders""",
)
def judgement_parse(spark, sf):
    reply = F.concat(
        F.lit("Extracted results: "), F.col("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "F", "\nnothing").otherwise("\n Format :  String "),
        F.lit("\nSCORE: 7\nscore:"), (F.col("o_custkey") % 2).cast("string"),
    )
    return table(spark, sf, "orders").select("o_orderkey", scoring.parse_judgement(reply).alias("j")).select("o_orderkey", "j.*")


@query(
    "list_answers",
    """SELECT p_partkey, CAST(p_size % 2 = 0 AS DOUBLE) AS exact, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS f1 FROM part""",
)
def list_answers(spark, sf):
    gold = F.array(F.concat(F.lit("the "), F.col("p_brand")), F.lit("twelve units"))
    ours = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("12 Units!"), F.upper("p_brand"))).otherwise(
        F.array(F.col("p_brand"), F.lit("13 units"))
    )
    return table(spark, sf, "part", spread=True).select("p_partkey", list_exact(ours, gold).alias("exact"), list_f1(ours, gold).alias("f1"))


def part_table():
    text = lambda c: c.cast("string")
    cell = lambda c, attrs="", tag="td": F.concat(F.lit(f"<{tag}{attrs}>"), c, F.lit(f"</{tag}>"))
    rows = [
        (cell(F.col("p_name"), ' colspan="2"', "th"), cell(F.col("p_brand"), "", "th")),
        (cell(F.col("p_type"), ' rowspan="2"'), cell(text(F.col("p_size"))), cell(text(F.col("p_retailprice")))),
        (cell(text(F.col("p_size") + 1)), cell(F.lit("12%"))),
    ]
    return F.concat(F.lit("<table>"), *[x for r in rows for x in (F.lit("<tr>"), *r, F.lit("</tr>"))], F.lit("</table>"))


def grids(spark, sf):
    return table(spark, sf, "part", spread=True).select("p_partkey", tables.grid(part_table()).alias("grid"))


@query(
    "table_grid",
    """SELECT p_partkey, r, c, CASE WHEN r = 0 AND c < 2 THEN p_name WHEN r = 0 THEN p_brand WHEN c = 0 THEN p_type
  WHEN r = 1 AND c = 1 THEN CAST(p_size AS VARCHAR) WHEN r = 1 THEN CAST(p_retailprice AS VARCHAR)
  WHEN c = 1 THEN CAST(p_size + 1 AS VARCHAR) ELSE '12%' END AS cell
FROM part, (SELECT CAST(unnest(range(3)) AS INTEGER) AS r), (SELECT CAST(unnest(range(3)) AS INTEGER) AS c)""",
)
def table_grid(spark, sf):
    rows = grids(spark, sf).select("p_partkey", F.posexplode("grid").alias("r", "row"))
    return rows.select("p_partkey", "r", F.posexplode("row").alias("c", "cell"))


@query(
    "table_headers",
    """SELECT p_partkey, 1 AS n_rows, least(p_name, p_brand) || '; ' || greatest(p_name, p_brand) AS headers, 3 AS n_columns FROM part""",
)
def table_headers(spark, sf):
    n = tables.header_rows(F.col("grid"))
    count = tables.column_count(F.col("html"))
    made = table(spark, sf, "part", spread=True).select("p_partkey", part_table().alias("html"))
    return made.withColumn("grid", tables.grid("html")).select(
        "p_partkey", n.alias("n_rows"), F.array_join(tables.headers(F.col("grid"), n), "; ").alias("headers"), count.alias("n_columns")
    )


BODY = """p_name || ' | ' || p_name || ' | ' || p_brand || chr(10) || p_type || ' | ' || p_size || ' | ' || p_retailprice || chr(10)
  || p_type || ' | ' || (p_size + 1) || ' | 12%'"""


@query(
    "table_text",
    f"""SELECT p_partkey, 'Caption: ' || p_brand || chr(10) || 'This table contains the following columns:' || chr(10)
  || ' - ' || least(p_name, p_brand) || chr(10) || ' - ' || greatest(p_name, p_brand) || chr(10) || chr(10)
  || 'Table Body:' || chr(10) || {BODY} AS text FROM part""",
)
def table_text(spark, sf):
    made = table(spark, sf, "part", spread=True).select("p_partkey", "p_brand", tables.grid(part_table()).alias("grid"))
    return made.select("p_partkey", tables.table_text(F.col("p_brand"), F.col("grid"), F.lit("")).alias("text"))


@query(
    "table_linearised",
    """SELECT p_partkey, 'Type: Text-heavy table (full linearization)' || chr(10)
  || 'Row 1: ''' || p_name || ''' is ''' || p_type || '''; ''' || p_name || ''' is ''' || p_size || '''; ''' || p_brand || ''' is ''' || p_retailprice || ''';' || chr(10)
  || 'Row 2: ''' || p_name || ''' is ''' || p_type || '''; ''' || p_name || ''' is ''' || (p_size + 1) || '''; ''' || p_brand || ''' is ''12%'';' AS text FROM part""",
)
def table_linearised(spark, sf):
    return grids(spark, sf).select("p_partkey", tables.linearised(F.lit(""), F.col("grid"), F.lit("")).alias("text"))


@query(
    "table_append_rows",
    """SELECT p_partkey, '<table><tr><td>' || p_size || '</td></tr><tr><td>' || p_brand || '</td></tr><tr><td>' || p_type || '</td></tr></table>' AS html FROM part""",
)
def table_append_rows(spark, sf):
    one = F.concat(F.lit("<table><tr><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    two = F.concat(
        F.lit("<table><tbody><tr><td>"), F.col("p_brand"), F.lit("</td></tr><tr><td>"), F.col("p_type"), F.lit("</td></tr></tbody></table>")
    )
    return table(spark, sf, "part").select("p_partkey", tables.append_rows(one, two).alias("html"))
