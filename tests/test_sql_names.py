"""SQL names on odd texts: every one gives what its Column gives."""

from pyspark.sql import functions as F

from modspark.catalog.common import derived_array
from modspark.catalog.texts import _sql_pairs
from modspark.functions import registry

TEXTS = [
    None, "", " ", "x", "$h!t @ss l@@zy !!", "1d10t f.u.n coooool    tail", "You IDIOT, idiot , moron clown", "saale bewakoof yaar", "SAALE, chup ſ K",
    "नमस्ते dost kya hai", "বাংলা লেখা", "kya", "main hoon na", '"quoted "', "'", "see https://a.b/c?d=1 @me 42", "café ​\t\t\n\n\n\nend", "аррlе", "word " * 2000,
]


def test_every_name_on_odd_texts(spark):
    names = registry.register(spark)
    pairs = _sql_pairs()
    assert {name for name, _, _ in pairs} == set(names) - set(registry._TABLES)
    rows = [(i, t, "en" if i % 2 else "hi", t if i % 3 else "src") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("x", (F.col("doc_id") % 101) / 100.0).withColumn("s", derived_array("doc_id"))
    rows = df.select("text", *[F.struct(F.expr(call).alias("sql"), column.alias("col")).alias(name) for name, call, column in pairs]).collect()
    assert [(name, r.text, r[name]) for r in rows for name, _, _ in pairs if r[name].sql != r[name].col] == []


def test_table_functions_on_nulls_and_empty_values(spark):
    registry.register(spark)
    got = spark.sql("SELECT i, seq, chunk FROM VALUES (1, 'a  b'), (2, ''), (3, NULL) v(i, t), LATERAL mod_chunks(t)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a "), (1, 1, " "), (1, 2, "b"), (2, 0, "")]
    got = spark.sql("SELECT i, position, message FROM VALUES (1, array('x', NULL)), (2, array()), (3, NULL) v(i, t), LATERAL mod_batch(t)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "x"), (1, 1, None)]
