"""Scans and text operators (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.config import STOPWORDS
from docketry.functions import text as T
from docketry.functions import vectors as V
from docketry.operators import corpus
from docketry.plans.fixtures import LEGAL, query, rows, table, tok

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_CONTENT = f"list_filter({tok('text')}, lambda t: NOT list_contains({_STOP}, t))"


def docs(s, d):
    return table(s, d, "documents")


@query("A05_load_corpus", "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def a05(s, d):
    return docs(s, d).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query("A07_load_queries", "SELECT item_id, text, 'test' AS split FROM benchmark WHERE item_id % 2 = 0")
def a07(s, d):
    split = F.when(F.col("item_id") % 2 == 0, "test").otherwise("validation")
    return table(s, d, "benchmark").select("item_id", "text", split.alias("split")).where("split = 'test'")


@query("A04_extract_metadata", """SELECT o_orderkey AS doc, concat('Ram v. State ', o_orderkey) AS case_name, concat(1 + o_orderkey % 28, '-01-2020') AS decision_date, concat('C.A. ', o_custkey) AS case_no,
  CASE o_orderstatus WHEN 'F' THEN 'Dismissed' END AS disposal_nature, 'A, B' AS bench FROM orders""")
def a04(s, d):
    raw = rows(s, d, """SELECT o_orderkey AS doc, concat('<div><button type="x" aria-label="Ram v. State ', o_orderkey, ' pdf">open</button><table><td class="caseDetailsTD"><b>Decision Date :</b> ', 1 + o_orderkey % 28,
      '-01-2020 | <b>Case No :</b> C.A. ', o_custkey, CASE o_orderstatus WHEN 'F' THEN ' | <b>Disposal Nature :</b> Dismissed' ELSE '' END, ' | <b>Bench :</b> A, B</td></table></div>') AS html FROM orders""")
    return raw.select("doc", *[c.alias(n) for n, c in corpus.extract_metadata(F.col("html")).items()])


@query("B01_tokenize", f"SELECT doc_id, CAST(len({tok('text')}) AS INT) AS n, md5(array_to_string({tok('text')}, ' ')) AS digest FROM documents")
def b01(s, d):
    t = T.tokenize(F.col("text"))
    return docs(s, d).select("doc_id", F.size(t).alias("n"), F.md5(F.concat_ws(" ", t)).alias("digest"))


@query("B02_content_tokens", f"SELECT doc_id, CAST(len({_CONTENT}) AS INT) AS n, md5(array_to_string({_CONTENT}, ' ')) AS digest FROM documents")
def b02(s, d):
    t = T.content_tokens(F.col("text"))
    return docs(s, d).select("doc_id", F.size(t).alias("n"), F.md5(F.concat_ws(" ", t)).alias("digest"))


@query("B03_normalize_space", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def b03(s, d):
    return docs(s, d).select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"))


@query("B04_split_sentences", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([a-z)\]"”’]{3}[.!?])\s+([A-Z"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
  SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS sentence FROM s""")
def b04(s, d):
    return docs(s, d).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("B05_clean_lines", r"""WITH l AS (SELECT doc_id, trim(x.line) AS line, x.pos AS pos FROM (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents) y, LATERAL (SELECT z[1] AS line, z[2] AS pos) x),
  m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n FROM l)
  SELECT doc_id, count(*) AS kept FROM m WHERE NOT (n >= 3 AND regexp_matches(line, '\sv\.?\s') AND length(line) < 160) AND line <> '' GROUP BY doc_id""")
def b05(s, d):
    return corpus.clean_lines(docs(s, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("B06_join_lines")
def b06(s, d):
    return corpus.join_lines(corpus.clean_lines(docs(s, d), "doc_id"), "doc_id")


@query("B07_split_sections", """SELECT o_orderkey AS doc, 'judgment' AS section, concat('The appeal is ', CASE o_orderstatus WHEN 'F' THEN 'dismissed' ELSE 'allowed' END, '.') AS text FROM orders
  UNION ALL SELECT o_orderkey, 'headnotes', concat('Point ', o_custkey % 9) FROM orders WHERE o_custkey % 9 > 0
  UNION ALL SELECT o_orderkey, 'front_matter', concat('Order ', o_orderkey) FROM orders""")
def b07(s, d):
    raw = rows(s, d, """SELECT o_orderkey AS doc, concat('Order ', o_orderkey, chr(10), 'Headnotes', chr(10), CASE WHEN o_custkey % 9 > 0 THEN concat('Point ', o_custkey % 9, chr(10)) ELSE '' END,
        'Judgment / Order of the Supreme Court', chr(10), 'The appeal is ', CASE o_orderstatus WHEN 'F' THEN 'dismissed' ELSE 'allowed' END, '.') AS text FROM orders""")  # fmt: skip
    return corpus.split_sections(corpus.clean_lines(raw, "doc"), "doc")


@query("B08_extract_result", "SELECT o_orderkey AS doc, CASE o_orderkey % 5 WHEN 4 THEN 'Costs made easy' ELSE concat('Appeal ', CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' ELSE 'partly allowed' END, CASE o_orderkey % 5 WHEN 3 THEN ' with directions' ELSE '' END) END AS result FROM orders")
def b08(s, d):
    raw = rows(s, d, """SELECT o_orderkey AS doc, concat('Result of the case: first try. Text. Result of the Case : ', CASE o_orderkey % 5 WHEN 0 THEN 'Adeeba M, Hony. Associate Editor ' WHEN 1 THEN '(Verified by: A. B.) ' ELSE '' END,
      CASE o_orderkey % 5 WHEN 4 THEN 'Costs made easy † Headnotes' ELSE concat('Appeal ', CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' ELSE 'partly allowed' END, CASE o_orderkey % 5 WHEN 3 THEN ' with directions' ELSE '' END, '.') END) AS text FROM orders""")
    return raw.select("doc", corpus.extract_result(F.col("text")).alias("result"))


@query("B09_front_matter", "SELECT s_suppkey, concat('Judge ', s_suppkey, '|Judge ', s_nationkey) AS judges, concat('Judge ', s_suppkey) AS author FROM supplier")
def b09(s, d):
    b = rows(s, d, "SELECT s_suppkey, concat('In the Court [Judge ', s_suppkey, '* and Judge ', s_nationkey, ', JJ.] 2024') AS text FROM supplier").withColumn("b", corpus.parse_bench(F.col("text")))
    return b.select("s_suppkey", F.concat_ws("|", "b.judges").alias("judges"), "b.author")


@query("B10_full_text", "SELECT doc_id, md5(array_to_string(list_filter([lang, '', left(text, 50), source], lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents")
def b10(s, d):
    return docs(s, d).select("doc_id", F.md5(T.assemble(F.col("lang"), F.lit(""), F.substring("text", 1, 50), F.col("source"))).alias("digest"))


@query("B11_legal_summary", "SELECT page_id, array_to_string(list_filter([url, '', CASE WHEN page_id % 2 = 0 THEN 'even' ELSE '' END], lambda x: x <> ''), chr(10)) AS summary FROM pages")
def b11(s, d):
    even = F.when(F.col("page_id") % 2 == 0, "even").otherwise("")
    return table(s, d, "pages").select("page_id", T.assemble(F.col("url"), F.lit(""), even, sep="\n").alias("summary"))


@query("B12_slices", "SELECT doc_id, md5(left(text, 60000)) AS body, md5(right(text, 3000)) AS tail, left(text, 600) AS issue FROM documents")
def b12(s, d):
    return docs(s, d).select("doc_id", *[c.alias(n) for n, c in T.slices(F.col("text")).items()]).withColumns({"body": F.md5("body"), "tail": F.md5("tail")})


@query("B13_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def b13(s, d):
    return table(s, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query("B14_chunks", f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents), c AS (SELECT doc_id, t, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 400 THEN 1 ELSE CAST(ceil((len(t) - 400) / 300.0) AS BIGINT) + 1 END AS n FROM t),
  e AS (SELECT doc_id, t, unnest(range(n)) * 300 AS start FROM c)
  SELECT doc_id, CAST(start AS INT) AS start, md5(array_to_string(t[start + 1 : start + 400], ' ')) AS digest FROM e""")
def b14(s, d):
    c = docs(s, d).select("doc_id", F.explode(T.chunks(T.tokenize(F.col("text")))).alias("c"))
    return c.select("doc_id", "c.start", F.md5(F.concat_ws(" ", "c.tokens")).alias("digest"))


@query("B15_pad_punctuation", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s*([–—])\s*', ' \1 ', 'g'), '([.!?])([A-Z])', '\1 \2', 'g'))) AS digest FROM documents")
def b15(s, d):
    return docs(s, d).select("doc_id", F.md5(T.pad_punctuation(F.col("text"))).alias("digest"))


@query("B16_squeeze_blank", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def b16(s, d):
    return docs(s, d).select("doc_id", F.md5(T.squeeze_blank(F.col("text"))).alias("digest"))


@query("B17_segments", r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), '\s+[–—]\s+', chr(1), 'g') AS t FROM documents)
  SELECT doc_id, CAST(len(list_filter(string_split(t, chr(1)), lambda x: trim(x) <> '')) AS INT) AS n FROM m""")
def b17(s, d):
    return docs(s, d).select("doc_id", F.size(T.segments(F.col("text"))).alias("n"))


@query("B18_paragraphs", r"SELECT doc_id, CAST(least(400, len(list_filter(regexp_split_to_array(text, '\n+'), lambda p: length(trim(p)) > 80))) AS INT) AS n FROM documents")
def b18(s, d):
    return docs(s, d).select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n"))


@query("B19_rounding", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_quantity / 8 AS DECIMAL(18, 3)), 2) AS DOUBLE) AS price FROM lineitem")
def b19(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.round_even(F.col("l_quantity") / 8, 2).alias("price"))


@query("B20_softmax", """WITH r AS (SELECT s_suppkey, [s_acctbal / 1000, s_nationkey * 0.1, 1.0] AS z FROM supplier), e AS (SELECT s_suppkey, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM r)
  SELECT s_suppkey, round(e[1] / list_sum(e), 6) AS p1, round(e[2] / list_sum(e), 6) AS p2, round(e[3] / list_sum(e), 6) AS p3 FROM e""")
def b20(s, d):
    z = F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey") * 0.1, F.lit(1.0))
    p = table(s, d, "supplier").select("s_suppkey", V.softmax(z).alias("p"))
    return p.select("s_suppkey", *[F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(3)])


@query("B21_minmax", """SELECT p_partkey, round(CASE WHEN p_size > 10 THEN (p_retailprice - lo) / nullif(hi - lo, 0) ELSE 0 END, 6) AS x FROM (
  SELECT *, min(p_retailprice) FILTER (WHERE p_size > 10) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) FILTER (WHERE p_size > 10) OVER (PARTITION BY p_brand) AS hi FROM part) y WHERE hi - lo >= 1e-12
  UNION ALL SELECT p_partkey, 0.0 FROM (SELECT *, min(p_retailprice) FILTER (WHERE p_size > 10) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) FILTER (WHERE p_size > 10) OVER (PARTITION BY p_brand) AS hi FROM part) y WHERE lo IS NULL OR hi - lo < 1e-12""")
def b21(s, d):
    return table(s, d, "part").select("p_partkey", F.round(V.minmax(F.col("p_retailprice"), F.col("p_size") > 10, "p_brand"), 6).alias("x"))


@query("B22_unit_rows", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12), 6) AS first FROM embeddings")
def b22(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.unit(F.col("embedding"))[0], 6).alias("first"))
