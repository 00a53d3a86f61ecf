"""Files into books over the given tables: people, titles, grouping, matching, and duplicates by real keys.

orders play the files: a part is a title ("small ring of economy Vol. 7"), an order's name one of several spellings of it. The SQL
of these queries doesn't read names: it is written from what the names were made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import best_strength, fuzzy_ratio, fuzzy_score, person, score_card, strength, title_identity
from ..functions.text import isbn13, search_key
from ..operators.matching import decided, grouped
from ..operators.resolve import staged_duplicates
from ..operators.sets import spread
from .registry import Tables, query

_TITLES = """
title AS (SELECT p_partkey, p_name || ' of ' || lower(p_type) || ' ' || p_size AS identity, translate(n_name, '0123456789_ ', 'abcdefghij') AS surname, string_split(p_name, ' ')[1] AS given FROM part JOIN nation ON n_nationkey = p_partkey % 25)
"""


def titles(t: Tables):
    """p_partkey, title, surname, given: a part as a book; nation is a table of fixed size."""
    x = t.part.join(F.broadcast(t.nation), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    number = F.concat(F.lit("Vol. "), F.col("p_size").cast("string"))
    title = F.concat_ws(" ", F.initcap("p_name"), F.lit("of"), F.lower("p_type"), number)
    return x.select("p_partkey", title.alias("title"), F.translate("n_name", "0123456789_ ", "abcdefghij").alias("surname"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("given"))


def spelled(x, kind):
    """A file's name: one of six spellings of its title."""
    title = F.col("title")
    year = F.concat(F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit(").epub"))
    return (
        F.when(kind == 0, F.concat(title, F.lit(".epub")))
        .when(kind == 1, F.concat(F.lit("The "), title, year))
        .when(kind == 2, F.concat(title, F.lit(" (1).mobi")))
        .when(kind == 3, F.concat(F.upper("title"), F.lit(" [Unabridged].m4b")))
        .when(kind == 4, F.concat(F.replace(title, F.lit("Vol. "), F.lit("Volume 0")), F.lit(".cbz")))
        .otherwise(F.concat(title, F.lit(" - Copy.epub")))
    )


def files(t: Tables, orders=None):
    """file, folder, name, author, book_part of orders: folders hold a fortieth of the titles, and an inbox the rest."""
    x = (t.orders if orders is None else orders).join(titles(t), F.col("o_custkey") == F.col("p_partkey"))
    kind = F.col("o_orderkey") % 6
    folder = F.when(F.col("o_totalprice").cast("long") % 2 == 0, 1000 + F.col("o_orderkey") % 41).otherwise(F.col("o_custkey") % 40)
    turn = F.col("o_orderkey") % 4
    author = F.when(turn == 0, F.concat("given", F.lit(" "), "surname")).when(turn == 1, F.concat("surname", F.lit(", "), "given")).when(turn == 2, F.concat(F.substring("given", 1, 1), F.lit(". "), "surname"))
    return x.select(F.col("o_orderkey").alias("file"), folder.alias("folder"), spelled(x, kind).alias("name"), author.alias("author"), "o_custkey", kind.alias("kind"))


_FILES = f"""
WITH RECURSIVE {_TITLES},
f AS (SELECT o_orderkey AS file, CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) % 2 = 0 THEN 1000 + o_orderkey % 41 ELSE o_custkey % 40 END AS folder, o_orderkey % 6 AS kind, o_orderkey % 4 AS turn, o_custkey, identity, surname, given,
  CASE WHEN o_orderkey % 6 IN (2, 5) THEN identity || ' 1' ELSE identity END AS own, CASE WHEN o_orderkey % 6 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) END AS y,
  CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE lower(surname) || ' ' || CASE WHEN o_orderkey % 4 = 2 THEN given[1] ELSE given END END AS who,
  CASE o_orderkey % 6 WHEN 2 THEN 'mobi' WHEN 3 THEN 'm4b' WHEN 4 THEN 'cbx' ELSE 'epub' END AS format
  FROM orders JOIN title ON p_partkey = o_custkey)
"""


@query(f"""
WITH {_TITLES}
SELECT p_partkey, 2 AS same, 2 AS turned, 2 AS initial, 1 AS bare, CASE WHEN given[1] = 'x' THEN 2 ELSE 0 END AS other, 0 AS stranger, 2 AS best FROM title
""")
def name_strengths(t: Tables):
    """How well spellings of a person's name agree: 2, 1 or 0."""
    x = titles(t)
    full = F.concat("given", F.lit(" "), "surname")
    spellings = {
        "same": F.concat(F.lit("Dr. "), F.upper(full), F.lit(" Jr.")),
        "turned": F.concat("surname", F.lit(", "), "given", F.lit(" Q.")),
        "initial": F.concat(F.substring("given", 1, 1), F.lit(". "), "surname"),
        "bare": F.col("surname"),
        "other": F.concat(F.lit("X. "), "surname"),
        "stranger": F.concat("given", F.lit(" Nobody")),
    }
    # each spelling is read once, in a projection of its own
    read = spread(x.select("p_partkey", full.alias("full"), *[s.alias(n) for n, s in spellings.items()]), "p_partkey")
    read = read.select("p_partkey", *[person(F.col(n)).alias(f"who_{n}") for n in ("full", *spellings)])
    found = [strength(F.col("who_full"), F.col(f"who_{n}")).alias(n) for n in spellings]
    best = best_strength(F.array("who_full"), F.array("who_stranger", "who_bare", "who_turned"))
    return read.select("p_partkey", *found, best.alias("best"))


@query(_FILES + "SELECT file, own AS identity, CASE WHEN kind IN (2, 5) THEN 1 END AS copy, CASE WHEN y IS NULL THEN [] ELSE [y] END AS years, identity AS without_copy FROM f")
def title_identities(t: Tables):
    """What a file's name says: title, volume, copy mark and years, for every file."""
    x = files(t)
    return x.select("file", title_identity(F.regexp_replace("name", r"\.\w+$", "")).alias("t")).select("file", "t.*")


@query("""
WITH RECURSIVE w AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS a, lower(p_type) AS b FROM part),
q AS (SELECT a, b FROM w UNION SELECT a, a FROM w UNION SELECT b, b FROM w),
s AS (SELECT a AS term, b AS query, 1 AS i, 0 AS pos, -9 AS before, 0 AS score FROM q
UNION ALL SELECT term, query, i + 1, CASE WHEN p > 0 THEN pos + p ELSE length(term) END, CASE WHEN p > 0 THEN pos + p ELSE before END, score + CASE WHEN p = 0 THEN 0 WHEN before + 1 = pos + p THEN 3 ELSE 1 END
FROM (SELECT *, strpos(substr(term, pos + 1), query[i]) AS p FROM s WHERE i <= length(query))),
e AS (SELECT term, query, score FROM s WHERE i = length(query) + 1)
SELECT p_partkey, e.score, round(e.score / greatest(x.score, y.score), 6) AS ratio, e.score / greatest(x.score, y.score) >= 0.5 AS agrees
FROM part JOIN e ON e.term = lower(string_split(p_name, ' ')[1]) AND e.query = lower(p_type) JOIN e x ON x.term = e.term AND x.query = e.term JOIN e y ON y.term = e.query AND y.query = e.query
""")
def fuzzy_agreement(t: Tables):
    """Fuzzy score of two words, its ratio to the better score of each with itself, and whether that reaches one half."""
    a, b = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lower("p_type")
    words = spread(t.part.select("p_partkey", a.alias("a"), b.alias("b")), "p_partkey")
    scored = words.select("p_partkey", "a", "b", fuzzy_score(F.col("a"), F.col("b")).alias("score"))
    ratio = fuzzy_ratio(F.col("a"), F.col("b"), F.col("score"))
    return scored.select("p_partkey", "score", F.round(ratio, 6).alias("ratio"), (ratio >= 0.5).alias("agrees"))


@query(_FILES + """
SELECT file, CASE WHEN kind = 4 THEN 100 ELSE s END AS score, CASE WHEN kind = 4 OR s >= 70 THEN 'COMIC' WHEN s >= 40 THEN 'BORDERLINE' ELSE 'NOT_COMIC' END AS verdict
FROM (SELECT file, kind, CASE WHEN contains(identity, 'economy') THEN 45 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 30 ELSE 0 END - CASE WHEN kind = 3 THEN 60 ELSE 0 END AS n, greatest(0, least(100, n)) AS s FROM f)
""")
def comic_verdicts(t: Tables):
    """Additive evidence with a decisive signal, and the verdict by two thresholds."""
    x = files(t)
    signals = [(F.col("name").endswith(".cbz"), 100, True), (F.lower("name").contains("economy"), 45, False), (F.col("o_custkey") % 2 == 0, 30, False), (F.col("name").endswith(".m4b"), -60, False)]
    score, verdict = score_card(signals)
    return x.select("file", score.alias("score"), verdict.alias("verdict"))


@query(_FILES + """,
c AS (SELECT f.*, CASE WHEN kind IN (2, 5) AND EXISTS (SELECT 1 FROM f g WHERE g.folder = f.folder AND g.identity = f.identity AND g.kind NOT IN (2, 5)) THEN identity ELSE own END AS l1 FROM f),
s AS (SELECT *, count(DISTINCT y) OVER (PARTITION BY folder, l1) > 1 AS split FROM c),
l AS (SELECT *, CASE WHEN split THEN l1 || ' (' || coalesce(y, 'no year') || ')' ELSE l1 END AS l2 FROM s),
a AS (SELECT folder, l2 FROM l WHERE who IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT surname) > 1),
b AS (SELECT l.*, l.folder || ':' || CASE WHEN a.l2 IS NOT NULL AND who IS NOT NULL THEN l.l2 || ' by ' || who ELSE l.l2 END AS k FROM l LEFT JOIN a USING (folder, l2)),
n AS (SELECT DISTINCT folder, identity, kind, y, k FROM b), e AS (SELECT DISTINCT x.k AS a, z.k AS b FROM n x JOIN n z ON x.folder = z.folder AND x.identity = z.identity AND x.kind = z.kind AND x.y IS NOT DISTINCT FROM z.y),
r AS (SELECT a, a AS x FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.x), m AS (SELECT a AS k, min(x) AS group_key FROM r GROUP BY 1)
SELECT file, group_key, count(*) OVER (PARTITION BY group_key) AS members FROM b JOIN m USING (k)
""")
def grouped_files(t: Tables):
    """New files of a folder into books: copy marks, years and authors that split a title, equal base names."""
    return grouped(files(t).select("file", "folder", "name", "author")).select("file", "group_key", "members")


_DECIDED = _FILES + """,
old AS (SELECT DISTINCT folder, own, y, CASE WHEN file % 10 = 0 THEN 1000000000 + o_custkey ELSE o_custkey END AS book FROM f WHERE file // 12 % 8 <> 0 AND o_custkey % 3 <> 0),
new AS (SELECT * FROM f WHERE file // 12 % 8 = 0),
h AS (SELECT new.file, count(DISTINCT book) AS books, min(book) AS book FROM new JOIN old ON old.folder = new.folder AND old.own IN (new.own, new.identity) AND (new.y IS NULL OR old.y IS NULL OR new.y = old.y) GROUP BY 1),
sh AS (SELECT c_custkey AS shell, identity, lower(surname) AS s, CASE c_custkey % 3 WHEN 0 THEN given WHEN 1 THEN '' ELSE 'zz' END AS g FROM customer JOIN title ON p_partkey = c_custkey),
r AS (SELECT new.*, shell, CASE WHEN who IS NULL OR lower(surname) <> s THEN 0 WHEN g = '' THEN 1 WHEN g = new.given OR (turn = 2 AND g[1] = new.given[1]) THEN 2 ELSE 0 END AS rank FROM new ANTI JOIN h USING (file) JOIN sh ON sh.identity = new.identity),
k AS (SELECT *, count(*) OVER (PARTITION BY file) AS shells FROM (SELECT * FROM r WHERE rank > 0 QUALIFY rank = max(rank) OVER (PARTITION BY file))),
o AS (SELECT *, max(rank) OVER (PARTITION BY shell) AS strongest, count(*) OVER (PARTITION BY shell, rank, format) AS twice FROM k WHERE shells = 1),
w AS (SELECT shell, count(DISTINCT folder) AS folders FROM o WHERE rank = strongest GROUP BY 1),
d AS (SELECT file, o.shell, rank = strongest AND folders = 1 AND max(twice) OVER (PARTITION BY o.shell, rank) = 1 AS holds FROM o JOIN w USING (shell)),
z AS (SELECT new.file, h.books, h.book, d.shell, d.holds, k.shells FROM new LEFT JOIN h USING (file) LEFT JOIN d USING (file) LEFT JOIN (SELECT DISTINCT file, shells FROM k) k USING (file)),
x AS (SELECT file, CASE WHEN books = 1 THEN 'attach-same-folder' WHEN books > 1 THEN 'ambiguous' WHEN holds THEN 'attach-shell' WHEN shells > 0 THEN 'ambiguous' ELSE 'new-book' END AS decision, coalesce(CAST(CASE WHEN books = 1 THEN book WHEN holds THEN shell END AS VARCHAR), '-') AS target FROM z)
"""


def _decisions(t: Tables):
    turn = F.floor(F.col("o_orderkey") / 12) % 8
    existing = files(t, t.orders.where((turn != 0) & (F.col("o_custkey") % 3 != 0)))
    existing = existing.withColumn("book", F.when(F.col("file") % 10 == 0, 1000000000 + F.col("o_custkey")).otherwise(F.col("o_custkey")))
    new = files(t, t.orders.where(turn == 0))
    who = F.col("c_custkey") % 3
    author = F.when(who == 0, F.concat("given", F.lit(" "), "surname")).when(who == 1, F.col("surname")).otherwise(F.concat(F.lit("Zz "), "surname"))
    shells = t.customer.join(titles(t), F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("shell"), F.col("title").alias("name"), author.alias("author"))
    return decided(new, existing, shells)


@query(_DECIDED + "SELECT file, decision, target FROM x")
def file_matching(t: Tables):
    """New files (every eighth dozen of orders) against books with files (the other orders) and books without (customers): the decision for each."""
    return _decisions(t)


@query(_DECIDED + "SELECT decision, count(*) AS files, count(DISTINCT nullif(target, '-')) AS books FROM x GROUP BY 1")
def file_matching_summary(t: Tables):
    """Counts of the decisions."""
    return _decisions(t).groupBy("decision").agg(F.count("*").alias("files"), F.count_distinct(F.nullif(F.col("target"), F.lit("-"))).alias("books"))


@query(f"""
WITH RECURSIVE {_TITLES},
b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'i' || p_partkey % 97 END AS isbn,
  [x FOR x IN [CASE WHEN p_partkey % 11 = 1 THEN 'a' || p_partkey % 53 END, CASE WHEN p_partkey % 7 = 1 THEN 'b' || p_partkey % 61 END, CASE WHEN p_partkey % 13 = 2 THEN 'c' || p_partkey % 41 END] IF x IS NOT NULL] AS ids,
  p_name || ' ' || p_type AS title, [surname, given] AS authors, p_size AS size, CAST(trunc(p_retailprice) AS BIGINT) % 100 AS price FROM part JOIN title USING (p_partkey)),
s1 AS (SELECT id, min(id) OVER w AS group_id, 'ISBN' AS stage FROM b WHERE isbn IS NOT NULL WINDOW w AS (PARTITION BY isbn) QUALIFY count(*) OVER w > 1),
k2 AS (SELECT id, unnest(ids) AS k FROM b WHERE id NOT IN (SELECT id FROM s1)),
e2 AS (SELECT x.id AS a, y.id AS b FROM k2 x JOIN k2 y USING (k)), r2 AS (SELECT a, a AS x FROM e2 UNION SELECT r2.a, e2.b FROM r2 JOIN e2 ON e2.a = r2.x),
s2 AS (SELECT a AS id, min(x) AS group_id, 'EXTERNAL_ID' AS stage FROM r2 GROUP BY 1 HAVING count(*) > 1),
k3 AS (SELECT id, title || '|' || unnest(authors) AS k FROM b WHERE id NOT IN (SELECT id FROM s1 UNION SELECT id FROM s2)),
e3 AS (SELECT x.id AS a, y.id AS b FROM k3 x JOIN k3 y USING (k)), r3 AS (SELECT a, a AS x FROM e3 UNION SELECT r3.a, e3.b FROM r3 JOIN e3 ON e3.a = r3.x),
s3 AS (SELECT a AS id, min(x) AS group_id, 'TITLE_AUTHOR' AS stage FROM r3 GROUP BY 1 HAVING count(*) > 1),
s4 AS (SELECT id, min(id) OVER w AS group_id, 'DIRECTORY' AS stage FROM b WHERE size % 5 > 0 AND id NOT IN (SELECT id FROM s1 UNION SELECT id FROM s2 UNION SELECT id FROM s3) WINDOW w AS (PARTITION BY size, price) QUALIFY count(*) OVER w > 1),
s5 AS (SELECT id, min(id) OVER w AS group_id, 'FILENAME' AS stage FROM b WHERE id NOT IN (SELECT id FROM s1 UNION SELECT id FROM s2 UNION SELECT id FROM s3 UNION SELECT id FROM s4) WINDOW w AS (PARTITION BY title) QUALIFY count(*) OVER w > 1)
SELECT id, group_id, stage FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5)
""")
def duplicate_books(t: Tables):
    """Duplicates in the reference's five stages: ISBN (10 becomes 13), any external id, title with a common author, directory, file name."""
    x = t.part.join(titles(t).select("p_partkey", "surname", "given"), "p_partkey")
    k = F.col("p_partkey")
    nine = F.lpad((k % 97).cast("string"), 9, "0")
    given13, given10 = F.when(k % 8 == 0, isbn13(F.concat(nine, F.lit("0")))), F.when(k % 8 == 4, F.concat(nine, F.lit("0")))
    # every second ISBN is given with ten figures; the check figure of the last is not read
    isbn = F.coalesce(given13, isbn13(given10))
    ids = F.array_compact(F.array(*[F.when(k % m == r, F.concat(F.lit(f"{kind}:"), (k % n).cast("string"))) for kind, m, r, n in (("goodreads", 11, 1, 53), ("asin", 7, 1, 61), ("comicvine", 13, 2, 41))]))
    title = search_key(F.concat_ws(" ", "p_name", "p_type"))
    by_author = F.transform(F.array("surname", "given"), lambda a: F.concat_ws("|", title, search_key(a)))
    place = F.when(F.col("p_size") % 5 > 0, F.concat_ws(":", "p_size", (F.col("p_retailprice").cast("long") % 100)))
    file = F.concat(F.replace(F.upper(F.concat_ws("_", "p_name", "p_type")), F.lit(" "), F.lit("-")), F.lit(".epub"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")), r"[_\-]", " "), r"[^a-z0-9\s]", ""), r"\s+", " "))
    rows = x.select(k.alias("id"), isbn.alias("isbn"), ids.alias("ids"), by_author.alias("by_author"), place.alias("place"), F.nullif(plain, F.lit("")).alias("plain"))
    stages = [("ISBN", F.col("isbn")), ("EXTERNAL_ID", F.col("ids")), ("TITLE_AUTHOR", F.col("by_author")), ("DIRECTORY", F.col("place")), ("FILENAME", F.col("plain"))]
    return staged_duplicates(rows, "id", stages)
