"""Sources made of the documents' words, and their skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.engine.session import table
from lorekeep.functions import skeleton as S
from lorekeep.operators.ingest import skeleton_sources
from lorekeep.plans.registry import register

_WORDS = "[a-zA-Z]{3,}"
#: Partitions of the documents.
PARTS = 192


def _words(spark, root):
    # Dealt anew: of a file's rows one task would read all, and a source is many times as long as its text.
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", "text").repartition(PARTS)
    return docs.select("doc_id", "lang", "source", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORDS), 0).alias("w"))


def _python(words):
    """Word by word a function, a constant, or a class with a field and a method; comments, blocks and bodies between them."""

    def unit(w, k):
        return (
            F.when(k % 3 == 0, F.concat(F.lit("def d_"), w, F.lit("(a, b=')',  # "), w, F.lit("\n        c: int = (1)) -> int:\n    x = {'"), w, F.lit("': 1}\n    if x:\n        y = 'def no():'\n    return x\n")))
            .when(k % 3 == 1, F.concat(F.lit("K_"), w, F.lit(" = '"), w, F.lit(" # no'\nif K_"), w, F.lit(" == 1:\n    z = 2\n")))
            .otherwise(F.concat(F.lit("class C_"), w, F.lit(":\n    '''of "), w, F.lit("'''\n    size: int\n\n    def m(self):\n        return self\n")))
        )

    return F.array_join(F.transform(words, unit), "\n")


@register(
    "skeleton_python",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents), u AS (
      SELECT doc_id, list_transform(w, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN 'def d_' || x || '(a, b='')'', c: int = (1)) -> int:' || chr(10) || '    pass'
        WHEN 1 THEN 'K_' || x || ' = ''' || x || ' # no'''
        ELSE 'class C_' || x || ':' || chr(10) || '    ''''''of ' || x || '''''''' || chr(10) || '    size: int' || chr(10) || '    def m(self):' || chr(10) || '        pass' || chr(10) END) AS u FROM w)
    SELECT doc_id, len(u) AS units, sha256(rtrim(array_to_string(u, chr(10) || chr(10)), chr(10))) AS skeleton_sha256 FROM u""",
)
def skeleton_python(spark, root):
    code = _words(spark, root).select("doc_id", F.size("w").cast("long").alias("units"), S.python_skeleton(_python(F.col("w"))).alias("s"))
    return code.select("doc_id", "units", F.sha2("s", 256).alias("skeleton_sha256"))


def _script(words):
    def unit(w, k):
        return (
            F.when(k % 5 == 0, F.concat(F.lit("export async function f_"), w, F.lit("(a,\n  b) {\n  return 1\n}")))
            .when(k % 5 == 1, F.concat(F.lit("class C_"), w, F.lit(" extends Base {\n  m() {}\n}")))
            .when(k % 5 == 2, F.concat(F.lit("const g_"), w, F.lit(" = async (x) => x")))
            .when(k % 5 == 3, F.concat(F.lit("let h_"), w, F.lit(" = function (y) {}")))
            .otherwise(F.concat(F.lit("  function inner_"), w, F.lit("() {}")))
        )

    return F.array_join(F.transform(words, unit), "\n")


@register(
    "skeleton_script",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents), u AS (
      SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM w), s AS (
      SELECT doc_id, string_agg(CASE k % 5 WHEN 0 THEN 'export async function f_' || x || '(a,' || chr(10) || '  b)' WHEN 1 THEN 'class C_' || x || ' extends Base'
        WHEN 2 THEN 'const g_' || x || ' = async (x) =>' ELSE 'let h_' || x || ' = function (y)' END, chr(10) ORDER BY k % 5, k) AS s FROM u WHERE k % 5 < 4 GROUP BY doc_id)
    SELECT doc_id, sha256(coalesce(s, '')) AS skeleton_sha256 FROM w LEFT JOIN s USING (doc_id)""",
)
def skeleton_script(spark, root):
    return _words(spark, root).select("doc_id", F.sha2(S.script_skeleton(_script(F.col("w"))), 256).alias("skeleton_sha256"))


@register(
    "skeleton_targets",
    """SELECT lang AS domain, source || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END AS source_file, count(*) AS chunks
    FROM documents WHERE doc_id % 2 = 0 AND len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{3,}')) > 60 GROUP BY 1, 2""",
)
def skeleton_targets(spark, root):
    """Documents of many words as large Python sources: of which files skeletons are kept."""
    n = F.col("doc_id")
    made = _words(spark, root).select(F.col("lang").alias("domain"), F.concat("source", F.when(n % 2 == 0, ".py").otherwise(".md")).alias("source_file"), F.size("w").alias("n"), F.concat(F.lit("def f(a):\n"), F.repeat(F.lit("    a += 1\n"), F.size("w"))).alias("text"))
    return skeleton_sources(made.withColumn("is_skeleton", S.shortened(F.col("source_file"), F.col("text"), lines=61).isNotNull()))
