"""A rescan's verdicts over the given tables, in the three ways a library is organised. The files are those of ``plans.matching``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.verdicts import rescanned
from .matching import _FILES, files, titles
from .registry import Tables, query


def _library(t: Tables, deep: bool = False):
    """(new files, existing files, shells): every eighth dozen of orders is new; customers are books without files, some of them twice."""

    def placed(x):
        path, folder = 1 + F.col("folder") % 2, F.concat(F.lit("f"), F.col("folder").cast("string"))
        # audiobooks lie in a folder below, so a folder's book is looked for above it
        below = F.when(F.col("kind") == 3, F.concat(folder, F.lit("/audio/"), (F.col("file") % 3).cast("string"))).otherwise(folder) if deep else folder
        return x.select("file", path.alias("path"), below.alias("folder"), "name", "author", "o_custkey")

    turn = F.floor(F.col("o_orderkey") / 12) % 8
    alternative = F.when(F.col("file") % 10 == 0, 1000000000 + F.col("o_custkey")).otherwise(F.col("o_custkey"))
    existing = placed(files(t, t.orders.where((turn != 0) & (F.col("o_custkey") % 3 != 0)))).withColumn("book", F.when(F.lit(deep), F.crc32(F.concat_ws(":", "path", "folder").cast("binary")) + F.col("file") % 2 * (F.col("path") - 1)).otherwise(alternative))
    new = placed(files(t, t.orders.where(turn == 0)))
    k = F.col("c_custkey")
    author = F.when(k % 11 == 5, None).when(k % 3 == 0, F.concat("given", F.lit(" "), "surname")).when(k % 3 == 1, F.col("surname")).otherwise(F.concat(F.lit("Zz "), "surname"))
    one = t.customer.join(titles(t), k == F.col("p_partkey"))
    copy = F.explode(F.when(k % 4 == 1, F.array(F.lit(0), F.lit(10000000))).otherwise(F.array(F.lit(0)))).alias("more")
    shells = one.select("*", copy).select((k + F.col("more")).alias("shell"), F.when(k % 7 == 3, 2).cast("long").alias("path"), F.col("title").alias("name"), author.alias("author"), ((k % 5 == 0) | (F.col("more") > 0)).alias("physical"), F.lit(None).cast("double").alias("number"))
    return new, existing, shells


_RESCAN = _FILES + """,
g AS (SELECT f.*, 1 + folder % 2 AS path, (1 + folder % 2) || ':f' || folder AS fk, CASE kind WHEN 2 THEN identity || ' 1' ELSE identity END AS v, CASE kind WHEN 2 THEN 1 WHEN 5 THEN 0 END AS mark, CASE turn WHEN 3 THEN NULL WHEN 2 THEN given[1] ELSE given END AS gv, lower(surname) AS sn, CASE kind WHEN 1 THEN 'y' || y WHEN 3 THEN 'u' WHEN 4 THEN 'v' ELSE 't' END || identity AS copies FROM f),
new AS (SELECT * FROM g WHERE file // 12 % 8 = 0),
old AS (SELECT *, CASE WHEN file % 10 = 0 THEN 1000000000 + o_custkey ELSE o_custkey END AS book FROM g WHERE file // 12 % 8 <> 0 AND o_custkey % 3 <> 0),
met AS (SELECT n.file, o.book, n.identity = o.identity AND n.kind = o.kind AND n.y IS NOT DISTINCT FROM o.y
  OR (n.v = o.v OR n.mark IS NOT NULL AND o.mark IS NULL AND n.identity = o.identity OR n.mark IS NULL AND o.mark IS NOT NULL AND n.identity = o.identity)
  AND (n.y IS NULL OR o.y IS NULL OR n.y = o.y) AND NOT coalesce(n.gv IS NOT NULL AND o.gv IS NOT NULL AND (n.sn <> o.sn OR NOT (n.gv = o.gv OR length(n.gv) = 1 AND starts_with(o.gv, n.gv) OR length(o.gv) = 1 AND starts_with(n.gv, o.gv))), false) AS ok
  FROM new n JOIN old o ON o.fk = n.fk AND o.identity = n.identity AND (n.v = o.v OR (n.mark IS NULL) <> (o.mark IS NULL) OR n.kind = o.kind)),
here AS (SELECT file, min(book) FILTER (ok) AS lo, max(book) FILTER (ok) AS hi FROM met GROUP BY 1),
sh AS (SELECT c_custkey + more AS shell, CASE WHEN c_custkey % 7 = 3 THEN 2 END AS spath, identity, more > 0 OR c_custkey % 5 = 0 AS physical, CASE WHEN c_custkey % 11 = 5 THEN NULL ELSE lower(surname) END AS s, CASE WHEN c_custkey % 11 = 5 THEN NULL ELSE CASE c_custkey % 3 WHEN 0 THEN given WHEN 1 THEN '' ELSE 'zz' END END AS gs FROM (SELECT *, unnest(CASE c_custkey % 4 WHEN 1 THEN [0, 10000000] ELSE [0] END) AS more FROM customer) JOIN title ON p_partkey = c_custkey),
pair AS (SELECT n.file, sh.*, n.kind = 2 AS as_copy, n.gv IS NOT NULL AND gs IS NOT NULL AND n.sn = s AND gs <> '' AND (gs = n.gv OR length(n.gv) = 1 AND starts_with(gs, n.gv)) AS agree, coalesce(spath <> n.path, false) AS elsewhere, n.gv IS NOT NULL AS named FROM new n JOIN sh ON sh.identity = n.identity),
fit AS (SELECT * FROM pair WHERE NOT elsewhere AND (s IS NULL AND physical OR agree)),
kinds AS (SELECT file, as_copy, min({'p': physical, 'i': shell})['i'] AS first, count(*) AS n, count(DISTINCT coalesce(s, '-') || '/' || coalesce(gs, '-')) = 1 AND count(*) FILTER (s IS NULL) = 0 AS same FROM fit GROUP BY 1, 2),
verdict AS (SELECT p.file, CASE WHEN n = 1 OR same THEN first END AS shell, CASE WHEN n = 1 AND NOT as_copy THEN 2 WHEN n = 1 OR same THEN 1 END AS rank, NOT coalesce(as_copy, true) AS strongly,
  CASE WHEN n IS NULL THEN 'fileless: no book with this title has the file''s author' WHEN n > 1 AND NOT same THEN 'fileless: several books qualify' ELSE 'fileless: title and author agree' || CASE WHEN n > 1 THEN ', one of ' || n || ' alike books' ELSE '' END || CASE WHEN as_copy THEN ' (" (1)" read as a copy)' ELSE '' END END AS said
  FROM (SELECT DISTINCT file FROM pair) p LEFT JOIN kinds USING (file)),
own AS (SELECT n.*, lo, hi, CASE WHEN lo = hi THEN lo END AS here, h.file IS NULL OR lo IS NULL AS open, vd.shell, vd.rank AS srank, coalesce(vd.strongly, false) AS strongly, vd.said FROM new n LEFT JOIN here h USING (file) LEFT JOIN verdict vd USING (file)),
mine AS (SELECT *, coalesce(here, CASE WHEN open THEN shell END) AS got, CASE WHEN here IS NOT NULL THEN 'folder' WHEN open AND shell IS NOT NULL THEN 'shell' END AS ok, CASE WHEN here IS NOT NULL THEN 2 WHEN open THEN srank END AS own_rank FROM own),
"""
_GROUPED = """
c AS (SELECT new.*, CASE WHEN kind IN (2, 5) AND EXISTS (SELECT 1 FROM new g WHERE g.fk = new.fk AND g.identity = new.identity AND g.kind NOT IN (2, 5)) THEN identity WHEN kind IN (2, 5) THEN identity || ' 1' ELSE identity END AS l1 FROM new),
s AS (SELECT *, count(DISTINCT y) OVER (PARTITION BY fk, l1) > 1 AS split FROM c),
l AS (SELECT *, CASE WHEN split THEN l1 || ' (' || coalesce(y, 'no year') || ')' ELSE l1 END AS l2 FROM s),
a AS (SELECT x.fk, x.l2 FROM l x JOIN l z ON x.fk = z.fk AND x.l2 = z.l2 AND x.gv IS NOT NULL AND z.gv IS NOT NULL AND (x.sn <> z.sn OR NOT (x.gv = z.gv OR length(x.gv) = 1 AND starts_with(z.gv, x.gv) OR length(z.gv) = 1 AND starts_with(x.gv, z.gv))) GROUP BY 1, 2),
b AS (SELECT l.*, l.fk || ':' || CASE WHEN a.l2 IS NOT NULL AND gv IS NOT NULL THEN l.l2 || ' by ' || l.sn || ' ' || gv ELSE l.l2 END AS k FROM l LEFT JOIN a USING (fk, l2)),
nm AS (SELECT DISTINCT fk, identity, kind, y, k FROM b), e AS (SELECT DISTINCT x.k AS a, z.k AS b FROM nm x JOIN nm z ON x.fk = z.fk AND x.identity = z.identity AND x.kind = z.kind AND x.y IS NOT DISTINCT FROM z.y),
r AS (SELECT a, a AS x FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.x), m AS (SELECT a AS k, min(x) AS group_key FROM r GROUP BY 1),
grp AS (SELECT file, group_key FROM b JOIN m USING (k)),
"""
_DECIDE = """
z AS (SELECT mine.*, group_key, max(own_rank) OVER (PARTITION BY group_key) AS top FROM mine JOIN grp USING (file)),
best AS (SELECT group_key, any_value(top) AS top, min(got) AS target, min(ok) AS tk, count(DISTINCT ok || got) > 1 AS split, arg_min(fk, file) AS cf FROM z WHERE own_rank = top GROUP BY 1),
refused AS (SELECT DISTINCT z.group_key FROM z JOIN best USING (group_key) WHERE NOT split AND coalesce(own_rank, 0) < 2 AND (
  tk = 'folder' AND open AND EXISTS (SELECT 1 FROM met WHERE met.file = z.file AND met.book = target) AND NOT EXISTS (SELECT 1 FROM met WHERE met.file = z.file AND met.book = target AND ok)
  OR tk = 'shell' AND EXISTS (SELECT 1 FROM pair WHERE pair.file = z.file AND pair.shell = target AND (pair.elsewhere OR pair.s IS NOT NULL AND pair.named AND NOT pair.agree) AND (z.top < 2 OR NOT pair.as_copy AND NOT z.strongly)))),
j AS (SELECT z.*, split, tk, refused.group_key IS NOT NULL AS ref, CASE WHEN NOT split AND refused.group_key IS NULL THEN target END AS final, coalesce(got <> target OR got IS NULL OR own_rank < z.top, false) AND NOT split AND refused.group_key IS NULL AS follows,
  CASE WHEN coalesce(got <> target OR got IS NULL OR own_rank < z.top, false) THEN cf ELSE fk END AS claim, {format} AS format_, {copies} AS copies_ FROM z LEFT JOIN best USING (group_key) LEFT JOIN refused USING (group_key)),
cl AS (SELECT final, max(x) AS names, max(sx) AS snames, count(DISTINCT lo) > 1 OR max(lo <> hi) AS folders, count(DISTINCT slo) > 1 OR max(slo <> shi) AS sfolders, max(cs) AS cs FROM (SELECT final, format_, count(DISTINCT copies_) > 1 AS x, count(DISTINCT copies_) FILTER (top = 2) > 1 AS sx, min(claim) AS lo, max(claim) AS hi, min(claim) FILTER (top = 2) AS slo, max(claim) FILTER (top = 2) AS shi, count(*) FILTER (top = 2) AS cs FROM j WHERE final IS NOT NULL AND tk = 'shell' GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT j.*, names OR folders AS bad, cs > 0 AND NOT snames AND NOT coalesce(sfolders, false) AS alone, folders, names FROM j LEFT JOIN cl ON cl.final = j.final AND tk = 'shell'),
o AS (SELECT *, final IS NOT NULL AND (tk = 'folder' OR NOT bad OR alone AND top = 2) AS kept, final IS NOT NULL AND NOT (tk = 'folder' OR NOT bad OR alone AND top = 2) AS claimed,
  CASE WHEN here IS NOT NULL THEN {same} WHEN NOT open THEN {several} ELSE coalesce(said, {turned}, 'fileless: no book has this title') END AS own_said FROM w)
SELECT file, CASE WHEN kept AND tk = 'folder' THEN 'attach-same-folder' WHEN kept THEN 'attach-shell' WHEN claimed OR split OR ref OR own_said LIKE '%several%' THEN 'ambiguous' ELSE 'new-book' END AS decision,
  CASE WHEN kept THEN CAST(final AS VARCHAR) ELSE '-' END AS target, group_key,
  CASE WHEN kept AND follows THEN 'group: follows the files that it would be one book with' WHEN kept THEN own_said
    WHEN claimed THEN 'claims: ' || CASE WHEN alone THEN 'yields to stronger ones, ' ELSE '' END || CASE WHEN folders THEN 'claimed by files of several folders' ELSE 'claimed by different files of one format' END
    WHEN split THEN 'group: its files match different books' WHEN ref THEN 'group: a file of it is not its book' ELSE own_said END AS reason,
  CASE WHEN kept AND top = 1 THEN 'attached' WHEN kept AND own_rank = 1 AND got = final THEN 'agrees' WHEN kept AND own_rank = 1 THEN 'yielded' WHEN claimed AND top = 1 AND alone THEN 'yielded' WHEN NOT kept AND (own_rank = 1 OR top = 1) THEN 'lost' ELSE '-' END AS weak_match
FROM o
"""
_SAID = {"same": "'folder: same title in the same folder'", "several": "'folder: several books in the folder have this title'", "turned": "CASE WHEN EXISTS (SELECT 1 FROM met WHERE met.file = w.file) THEN 'folder: the books with this title are another author''s or year''s' END"}


@query(_RESCAN + _GROUPED + _DECIDE.format(format="format", copies="copies", **_SAID))
def rescan_verdicts(t: Tables):
    """Every new file's verdict where titles tell books apart: folder, books without files, its group, and claims."""
    return rescanned(*_library(t))


@query(_RESCAN.replace("open, vd.shell", "true AS open, vd.shell").replace("h.file IS NULL OR lo IS NULL AS true AS open", "true AS open").replace("CASE WHEN lo = hi THEN lo END AS here", "CAST(NULL AS BIGINT) AS here") + """
grp AS (SELECT file, new.fk || ':' || CASE kind WHEN 0 THEN t || '.epub' WHEN 1 THEN 'The ' || t || ' (' || y || ').epub' WHEN 2 THEN t || ' (1).mobi' WHEN 3 THEN upper(t) || ' [Unabridged].m4b' WHEN 4 THEN replace(t, 'Vol. ', 'Volume 0') || '.cbz' ELSE t || ' - Copy.epub' END AS group_key
  FROM (SELECT new.*, array_to_string([upper(w[1]) || substr(w, 2) FOR w IN string_split(p_name, ' ')], ' ') || ' of ' || lower(p_type) || ' Vol. ' || p_size AS t FROM new JOIN part ON p_partkey = o_custkey) new),
""" + _DECIDE.format(format="'file'", copies="group_key", **{**_SAID, "turned": "NULL"}))
def rescan_per_file(t: Tables):
    """Every new file's verdict where each file is a book: only books without files are looked at, and get one file."""
    return rescanned(*_library(t), mode="BOOK_PER_FILE")


def _per_folder() -> str:
    place = "CASE kind WHEN 3 THEN 'f' || folder || '/audio/' || file % 3 ELSE 'f' || folder END"
    rescan = _RESCAN.replace("(1 + folder % 2) || ':f' || folder AS fk", f"(1 + folder % 2) || ':' || {place} AS fk, (1 + folder % 2) || ':f' || folder AS up")
    # which of two books a folder has is the fixture's; SQL needs only how many
    rescan = rescan.replace("CASE WHEN file % 10 = 0 THEN 1000000000 + o_custkey ELSE o_custkey END AS book", "fk || '/' || file % 2 * (path - 1) AS book")
    a, b = rescan.index("met AS ("), rescan.index("here AS (")
    rescan = rescan[:a] + rescan[b:]
    a, b = rescan.index("here AS ("), rescan.index("sh AS (")
    here = """bk AS (SELECT fk, min(book) AS lo, max(book) AS hi FROM old GROUP BY 1), bu AS (SELECT up AS fk, min(book) AS lo, max(book) AS hi FROM old WHERE kind <> 3 GROUP BY 1),
here AS (SELECT n.file, coalesce(k.lo, u.lo) AS lo, coalesce(k.hi, u.hi) AS hi, k.fk IS NULL AS above FROM new n LEFT JOIN bk k ON k.fk = n.fk LEFT JOIN bu u ON u.fk = n.up AND n.kind = 3 WHERE coalesce(k.lo, u.lo) IS NOT NULL),
"""
    rescan = rescan[:a] + here + rescan[b:]
    rescan = rescan.replace("coalesce(here, CASE WHEN open THEN shell END) AS got", "coalesce(here, CASE WHEN open THEN CAST(shell AS VARCHAR) END) AS got").replace("SELECT n.*, lo, hi,", "SELECT n.*, lo, hi, above,")
    group = """
eb AS (SELECT DISTINCT up FROM new WHERE kind <> 3),
grp AS (SELECT file, CASE WHEN kind <> 3 OR EXISTS (SELECT 1 FROM eb WHERE eb.up = new.up) THEN up ELSE fk END AS group_key FROM new),
"""
    decide = _DECIDE.format(format="format", copies="copies", same="'folder: the book of ' || CASE WHEN above THEN 'the nearest folder above with an ebook' ELSE 'its folder' END", several="'folder: several books have files in ' || CASE WHEN above THEN 'the nearest folder above with an ebook' ELSE 'its folder' END", turned="NULL")
    a, b = decide.index("  tk = 'folder' AND open"), decide.index("  OR tk = 'shell'")
    decide = decide[:a] + "  false" + decide[b + 1 :].replace("pair.shell = target", "CAST(pair.shell AS VARCHAR) = target")
    return rescan + group + decide.replace("CAST(final AS VARCHAR)", "CASE tk WHEN 'folder' THEN 'a folder''s book' ELSE final END")


@query(_per_folder())
def rescan_per_folder(t: Tables):
    """Every new file's verdict where a folder is a book; targets that are folders' books are only named as such."""
    out = rescanned(*_library(t, deep=True), mode="BOOK_PER_FOLDER")
    return out.withColumn("target", F.when(F.col("decision") == "attach-same-folder", "a folder's book").otherwise(F.col("target")))
