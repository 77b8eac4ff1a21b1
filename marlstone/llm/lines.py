"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go, the earliest stays.

Two lines are within one edit (insertion, deletion or substitution of a character) in just two ways. Either they have the same length and
dropping the character at one position makes them equal, or dropping one character of the longer gives the shorter. So each line
emits as hashed keys all its variants: itself, and itself without each of its characters, with and without the position. Lines that
share a key of the first kind are all within one edit of each other, so the earliest of them answers for all; of the second kind
the shorter is a single line, which answers for the longer ones, and the earliest of those answers for it. No key needs pairs,
however many lines share it. The partner found is verified with the edit distance of the texts.

A line can only have a partner if it shares its first or its last half with another line of fitting length, so lines that share neither
with any other line emit nothing. Equal lines are one line with the earliest of their places, which is where it is kept.

A line goes if an earlier line is within the bound (even if that one goes too). Lines are in the order (id, hash of the text, number). Defined cases:
blank lines (only spaces) never go and count as no line. A row whose lines
other than blank ones all go is dropped; a row with a null, empty or blank text stays as it is. A null id stands first. Of repeated rows (equal id
and text) the first stays and the rest go as copies. Extra columns are carried along, whatever their names; a gone_col that is the name of one is refused. An empty table gives
no rows. Ids are whole numbers. Texts and lines of any length are handled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, identified, key_filter, mix, slices

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
SUBSTITUTED, WHOLE, SHORTENED = 0, 1, 2


def variant_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all variants of the lines: for each, the number of its line, its kind and a 64-bit hash. The hash of a line is a
    polynomial in its mixed code points modulo 2**64, so dropping one needs only the sums before and after it."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    codes = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    line = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - begin[line]
    powers = np.full(int(sizes.max()) + 1, _B, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = codes * powers[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    before = total[:-1] - total[begin[line]]
    whole = total[begin + sizes] - total[begin]
    short = before + (whole[line] - before - terms) * _B_INVERSE
    n = sizes.astype(np.uint64)
    one = mix(short + mix(n[line] - np.uint64(1)))
    at = mix(one ^ mix(place.astype(np.uint64) + np.uint64(1 << 32)))
    own = mix(whole + mix(n))
    # the same shortened line may come from several places of one line; one key is enough
    first = np.ones(len(codes), bool)
    first[1:] = (short[1:] != short[:-1]) | (line[1:] != line[:-1])
    return (
        np.concatenate([line, np.arange(len(texts)), line[first]]),
        np.concatenate([np.full(len(line), SUBSTITUTED, np.int8), np.full(len(texts), WHOLE, np.int8), np.full(int(first.sum()), SHORTENED, np.int8)]),
        np.concatenate([at, own, one[first]]),
    )


def _emit(batches):
    for b in slices(batches):
        texts = b.column("line").to_pylist()
        begin = size = 0
        for i, t in enumerate([*texts, None]):
            if t is None or size and size + len(t) > 1 << 18:
                line, kind, key = variant_keys(texts[begin:i])
                rows = pa.array(line + begin)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(kind), *(b.column(c).take(rows) for c in ("kid", "th", "no"))], names=["key", "kind", "kid", "th", "no"])
                begin, size = i, 0
            size += len(t or "")


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is at most 1, in linear time: behind the common prefix one character is replaced, is dropped, or nothing is left."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if a[low:k] == b[low:k] else (low, k - 1)
    return a[low + 1 :] == b[low + 1 :] or a[low:] == b[low + 1 :] or a[low + 1 :] == b[low:]


def _verified(batches):
    for b in slices(batches):
        near = [within_one(x, y) for x, y in zip(b.column("line").to_pylist(), b.column("partner_line").to_pylist())]
        yield b.select(["kid", "th", "no"]).filter(pa.array(near, pa.bool_()))


def _lines(own: DataFrame) -> DataFrame:
    """The lines that count, of rows that have kid, th and text."""
    return own.where("text is not null").select("kid", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.trim("line") != "")


def near_earlier(lines: DataFrame, firsts: DataFrame, own: DataFrame) -> DataFrame:
    """Places (kid, th, no) of distinct lines that have an earlier distinct line within one edit."""
    n = F.length("line")
    halves = []
    for shorter in (n, n - 1):  # a line may be the shorter of a pair, or as long, or the longer
        half = F.floor(shorter / 2).cast("int")
        halves += [F.xxhash64(F.lit(0), shorter, F.substring("line", 1, half)), F.xxhash64(F.lit(1), shorter, F.substring("line", n - half + 1, half))]
    keyed = lines.select(F.xxhash64("line").alias("h1"), F.explode(F.array(*halves)).alias("half"))
    shared = keyed.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    chosen = keyed.join(shared, "half", "left_semi").select("h1").distinct()
    places = as_table(firsts.join(chosen, "h1", "left_semi").select("kid", "th", "no"), "near-places")
    per_doc = places.groupBy(F.col("kid").alias("k"), F.col("th").alias("t")).agg(F.collect_set("no").alias("nos"))
    texts = key_filter(places, own.select("kid", "th", "text")).join(per_doc, (F.col("kid") == F.col("k")) & (F.col("th") == F.col("t")))
    found = texts.select("kid", "th", "nos", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.array_contains("nos", F.col("no")))
    found = as_table(found.select("kid", "th", "no", "line").dropDuplicates(["kid", "th", "no"]), "near-lines")
    keys = found.mapInArrow(_emit, "key long, kind tinyint, kid long, th long, no int")
    of_key = Window.partitionBy("key")
    seen = keys.withColumn("place", F.struct("kid", "th", "no"))
    for name, kind in (("a", SUBSTITUTED), ("b", WHOLE), ("c", SHORTENED)):
        seen = seen.withColumn(name, F.min(F.when(F.col("kind") == kind, F.col("place"))).over(of_key))
    partner = F.when(F.col("kind") == SUBSTITUTED, F.col("a")).when(F.col("kind") == WHOLE, F.col("c")).otherwise(F.col("b"))
    pairs = seen.withColumn("partner", partner).where("partner < place").select("kid", "th", "no", F.col("partner.kid").alias("pkid"), F.col("partner.th").alias("pth"), F.col("partner.no").alias("pno")).distinct()
    other = found.select(F.col("kid").alias("pkid"), F.col("th").alias("pth"), F.col("no").alias("pno"), F.col("line").alias("partner_line"))
    pairs = pairs.join(found, ["kid", "th", "no"]).join(other, ["pkid", "pth", "pno"])
    return pairs.select("kid", "th", "no", "line", "partner_line").mapInArrow(_verified, "kid long, th long, no int").distinct()


def _cut(batches, text_col: str):
    for b in slices(batches, 256):
        row = b.column("row")
        texts, drops, copies = row.field(text_col).to_pylist(), b.column("drops").to_pylist(), b.column("copy").to_pylist()
        out, gone, stays = [], [], []
        for t, drop, copy in zip(texts, drops, copies):
            if t is None or (not drop and copy == 1):
                out.append(t)
                gone.append(0)
                stays.append(True)
                continue
            lines, drop = t.split("\n"), set(drop or ())
            left = [x for i, x in enumerate(lines) if not x.strip(" ") or (copy == 1 and i not in drop)]
            out.append("\n".join(left))
            gone.append(len(lines) - len(left))
            stays.append(len(left) == len(lines) or any(x.strip(" ") for x in left))
        keep = pa.array(stays)
        yield pa.record_batch([row, pa.array(out, pa.string()), pa.array(gone, pa.int32())], names=["row", "text", "gone"]).filter(keep)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", gone_col: str | None = None) -> DataFrame:
    """docs with the text cut down to the lines that stay; chars_col, if docs has it, is counted anew; gone_col counts the lines that went."""
    if gone_col in docs.columns:
        raise ValueError(f"there is a column {gone_col} already")
    own = identified(docs, id_col, text_col)
    hashed = as_table(_lines(own).select("kid", "th", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    firsts = hashed.groupBy("h1", "h2").agg(F.min(F.struct("kid", "th", "no")).alias("first"), F.count("*").alias("c"))
    firsts = as_table(firsts.select("h1", "h2", "first.*", "c"), "firsts")
    near = near_earlier(_lines(own), firsts, own).withColumn("near", F.lit(True))
    known = firsts.join(near, ["kid", "th", "no"], "left").where("c > 1 or near")
    known = known.select("h1", "h2", F.struct("kid", "th", "no").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    drops = hashed.join(known, ["h1", "h2"]).where(F.col("near") | (F.struct("kid", "th", "no") != F.col("first")))
    drops = drops.groupBy("kid", "th").agg(F.collect_list("no").alias("drops"))
    rows = identified(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).drop("text")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("kid", "th").orderBy("kid")))
    cut = rows.join(drops, ["kid", "th"], "left").select("row", "drops", "copy")
    row_type = rows.schema["row"].dataType.simpleString()
    out = cut.mapInArrow(lambda batches: _cut(batches, text_col), f"row {row_type}, text string, gone int")
    columns = [F.col("text").alias(c) if c == text_col else (F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"row.`{c}`")) for c in docs.columns]
    return out.select(*columns, *([F.col("gone").alias(gone_col)] if gone_col else []))


# variants are compared by characters: DuckDB's levenshtein counts bytes
SQL = """
WITH l AS (
  SELECT doc_id, no, line, row_number() OVER (ORDER BY doc_id, no) AS pos
  FROM (SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), f AS (
  SELECT line, min(pos) AS pos, length(line) AS n FROM l WHERE trim(line) <> '' GROUP BY line
), v AS (
  SELECT pos, n, i, hash(substr(line, 1, i) || substr(line, i + 2)) AS h, line FROM (SELECT *, unnest(range(n)) AS i FROM f)
), w AS (
  SELECT pos, n, hash(line) AS h, line FROM f
), near AS (
  SELECT b.pos FROM v a JOIN v b ON a.h = b.h AND a.i = b.i AND a.n = b.n AND a.pos < b.pos WHERE substr(a.line, 1, a.i) || substr(a.line, a.i + 2) = substr(b.line, 1, b.i) || substr(b.line, b.i + 2)
  UNION SELECT b.pos FROM w a JOIN v b ON a.h = b.h AND a.n = b.n - 1 AND a.pos < b.pos WHERE a.line = substr(b.line, 1, b.i) || substr(b.line, b.i + 2)
  UNION SELECT b.pos FROM v a JOIN w b ON a.h = b.h AND a.n = b.n + 1 AND a.pos < b.pos WHERE substr(a.line, 1, a.i) || substr(a.line, a.i + 2) = b.line
), k AS (
  SELECT l.doc_id, l.no, l.line, trim(l.line) = '' AS blank, f.pos IS NULL OR (f.pos = l.pos AND l.pos NOT IN (SELECT pos FROM near)) AS stays
  FROM l LEFT JOIN f ON l.line = f.line
)
SELECT documents.* REPLACE (x.text AS text, CASE WHEN x.text IS NOT NULL THEN length(x.text) END AS n_chars), lines_gone
FROM documents JOIN (
  SELECT doc_id, string_agg(CASE WHEN stays THEN line END, chr(10) ORDER BY no) AS text, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS lines_gone
  FROM k GROUP BY doc_id HAVING bool_and(stays) OR bool_or(stays AND NOT blank)
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
) x USING (doc_id)
"""
