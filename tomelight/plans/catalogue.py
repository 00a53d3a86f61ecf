"""Browsing: facets, search, sorting, scalar text functions over part, documents and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import banded
from ..functions.text import clean_file_name, file_type, isbn10, isbn13, token_counts_cosine, truncated, valid_isbn
from ..operators.facets import Facet, facet_counts, filtered, multi_sort, natural_key, searched, surname_first
from ..operators.sets import spread
from .registry import Tables, query

SIZE_BANDS = [("tiny", 0, 10), ("small", 11, 20), ("medium", 21, 30), ("large", 35, 50)]


def part_facets() -> list[Facet]:
    return [Facet("brand", F.col("p_brand")), Facet("words", F.split("p_type", " "), many=True), Facet("size", banded(F.col("p_size"), SIZE_BANDS))]


_BAND = "CASE WHEN p_size BETWEEN 0 AND 10 THEN 'tiny' WHEN p_size BETWEEN 11 AND 20 THEN 'small' WHEN p_size BETWEEN 21 AND 30 THEN 'medium' WHEN p_size BETWEEN 35 AND 50 THEN 'large' END"


@query(f"""
WITH x AS (SELECT p_brand, p_type, {_BAND} AS size, p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AS b, coalesce({_BAND} IN ('tiny', 'large'), false) AS s FROM part),
c AS (SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM x WHERE s GROUP BY 2
UNION ALL SELECT 'size', size, count(*) FROM x WHERE b AND size IS NOT NULL GROUP BY 2
UNION ALL SELECT 'words', value, count(*) FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS value FROM x WHERE s AND b) GROUP BY 2)
SELECT facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 100
""")
def cascading_facets(t: Tables):
    """Counts of three facets; each ignores its own filter and respects the others'."""
    return facet_counts(t.part, part_facets(), {"brand": ["Brand#11", "Brand#12", "Brand#23"], "size": ["tiny", "large"]})


@query(f"SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND NOT coalesce({_BAND} IN ('large'), false) OR false")
def facet_filter(t: Tables):
    rows = filtered(t.part, part_facets(), {"brand": ["Brand#11", "Brand#12"]})
    return filtered(rows, part_facets(), {"size": ["large"]}, mode="not").select("p_partkey")


@query(f"SELECT coalesce({_BAND}, 'none') AS band, count(*) AS books, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1")
def band_histogram(t: Tables):
    """Bands with a gap: values between two bands are in none."""
    band = F.coalesce(banded(F.col("p_size"), SIZE_BANDS), F.lit("none"))
    return t.part.groupBy(band.alias("band")).agg(F.count("*").alias("books"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '11') OR contains(lower(p_brand), '11')")
def text_search(t: Tables):
    """Search over several normalised columns."""
    return searched(t.part, [F.col("p_name"), F.col("p_brand")], " 11 ").select("p_partkey", "p_name")


@query(r"""SELECT doc_id FROM documents WHERE contains(regexp_replace(regexp_replace(lower(strip_accents(text)), '[!@$%^&*_=|~`<>?/"]', '', 'g'), '\s+', ' ', 'g'), 'elle que')""")
def accent_free_search(t: Tables):
    """Search that ignores accents and case."""
    return searched(t.documents, [F.col("text")], "Elle QUÉ").select("doc_id")


@query("SELECT doc_id, lang, source FROM documents ORDER BY lang DESC, CAST(substr(source, 4) AS INTEGER), doc_id LIMIT 200")
def natural_multi_sort(t: Tables):
    """Several keys; digit runs compare as numbers."""
    keys = multi_sort([(F.col("lang"), True), (natural_key(F.col("source")), False), (F.col("doc_id"), False)])
    return t.documents.orderBy(*keys).limit(200).select("doc_id", "lang", "source")


@query(r"SELECT c_custkey, regexp_replace(replace(c_name, '#', ' '), '^(.*)\s+(\S+)$', '\2, \1') AS author FROM customer")
def surname_keys(t: Tables):
    return t.customer.select("c_custkey", surname_first(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("author"))


@query("""
WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS nine FROM part),
c AS (SELECT p_partkey, nine, list_sum([(11 - i) * CAST(nine[i] AS INTEGER) for i in range(1, 10)]) AS s10, list_sum([CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END * CAST(('978' || nine)[i] AS INTEGER) for i in range(1, 13)]) AS s13 FROM b),
d AS (SELECT p_partkey, nine || CASE WHEN (11 - s10 % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - CAST(s10 AS BIGINT) % 11) % 11 AS VARCHAR) END AS ten, '978' || nine || CAST((10 - CAST(s13 AS BIGINT) % 10) % 10 AS VARCHAR) AS thirteen FROM c)
SELECT p_partkey, ten, thirteen, true AS valid_ten, true AS valid_thirteen FROM d
""")
def isbn_conversion(t: Tables):
    """ISBN-13 from ISBN-10 and back, with checksums."""
    nine = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    thirteen = isbn13(F.concat(nine, F.lit("0")))
    ten = isbn10(thirteen)
    return spread(t.part.select("p_partkey"), "p_partkey").select("p_partkey", ten.alias("ten"), thirteen.alias("thirteen"), valid_isbn(ten).alias("valid_ten"), valid_isbn(thirteen).alias("valid_thirteen"))


@query(r"""
SELECT page_id, lower(regexp_extract(u, '\.([A-Za-z0-9]+)$', 1)) AS kind FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+', '') AS u FROM pages) WHERE regexp_extract(u, '\.([A-Za-z0-9]+)$', 1) <> ''
""")
def file_types(t: Tables):
    """Type by the path's extension."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://[^/]+", "")
    return t.pages.select("page_id", file_type(path).alias("kind")).where("kind is not null")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(source || ' (copy (' || lang || ')) v1.epub', '\.[A-Za-z0-9]{1,5}$', ''), '\s*\(copy \([a-z]+\)\)', ''), '[\s_]+', ' ', 'g')) AS name FROM documents")
def clean_file_names(t: Tables):
    """File names without extension, nested parentheses and runs of spaces."""
    return t.documents.select("doc_id", clean_file_name(F.concat("source", F.lit(" (copy ("), "lang", F.lit(")) v1.epub"))).alias("name"))


@query(r"SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_extract(substr(text, 1, 61), '^(.*)\s', 1, 's') END AS term FROM benchmark")
def truncated_terms(t: Tables):
    return t.benchmark.select("item_id", truncated(F.col("text")).alias("term"))


@query("""
WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_name || ' ' || p_type || ' ' || p_type), ' ') AS b FROM part),
d AS (SELECT p_partkey, list_sum([len(list_filter(a, lambda y: y = x)) * len(list_filter(b, lambda y: y = x)) for x in list_distinct(list_intersect(a, b))]) AS dot,
sqrt(list_sum([len(list_filter(a, lambda y: y = x)) ** 2 for x in list_distinct(a)])) AS na, sqrt(list_sum([len(list_filter(b, lambda y: y = x)) ** 2 for x in list_distinct(b)])) AS nb FROM w)
SELECT p_partkey, round(coalesce(dot, 0) / (na * nb), 6) AS cosine FROM d
""")
def token_cosine(t: Tables):
    """Cosine of the token counts of two texts: a title, and the title with its kind twice."""
    return t.part.select("p_partkey", F.round(token_counts_cosine(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type", "p_type")), 6).alias("cosine"))


@query("""
SELECT n_nationkey, n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) = 0 AS unshelved FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey
""")
def catalogue_counts(t: Tables):
    """Counts of each library and shelf in one row, zero where nothing is held."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    x = t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    n = F.coalesce("c", F.lit(0))
    return x.select("n_nationkey", "n_name", n.alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"), (n == 0).alias("unshelved"))
