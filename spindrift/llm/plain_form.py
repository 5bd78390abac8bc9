"""Problem 1: text that looks the same brought to one form, by DuckDB SQL inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoding
from ._shared import spread

#: Full-width ASCII stands 0xFEE0 above its plain form.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_ASCII = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)
# Half-width katakana and signs from U+FF61 on, in their order, and full-width signs from U+FFE0 on.
HALF_KANA = "".join(map(chr, range(0xFF61, 0xFFA0)))
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"
WIDE_SIGNS, PLAIN_SIGNS = "￠￡￢￥￦￨￩￪￫￬￭￮｟｠", "¢£¬¥₩│←↑→↓■○⦅⦆"
# Ligature signs and Roman numeral signs with their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
NUMERALS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "L", "C", "D", "M")
SIGNS = LIGATURES | {chr(0x2160 + i): n for i, n in enumerate(NUMERALS)} | {chr(0x2170 + i): n.lower() for i, n in enumerate(NUMERALS)}
#: Further half-width forms and ligature signs, by their ranges, with the letters of their compatibility form: half-width Hangul, Latin digraph
#: signs, Armenian, Hebrew and Arabic ligatures and the shapes of Arabic letters.
LIGATURE_RANGES = ((0xFFA1, 0xFFDC), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFB13, 0xFB17), (0xFB1D, 0xFB4F), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC))
OTHER_SIGNS = {c: k for lo, hi in LIGATURE_RANGES for c in map(chr, range(lo, hi + 1)) if (k := unicodedata.normalize("NFKC", c)) != c}
# Characters without width, and spaces other than U+0020, as classes of RE2.
INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}"
    r"\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
)
SPACES = r"[\x{0009}-\x{000D}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Letters of other alphabets that look like the Latin letter below them.
ALIKE_OTHER = "АВЕЅІЈКМНОРСТХУҮавеѕіјкмнорстхуԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχϲᴦՕՏՍօոսցհզάίόΆΈΌΊёЁїЇ"
ALIKE_LATIN = "ABESIJKMHOPCTXYYabesijkmhopctxydqwhABEZHIKMNOPTYXaeikvoptuxcrOSUonughqáíóÁÉÓÍëËïÏ"
# The way back, for words of another alphabet with stray Latin letters.
LATIN_IN = "ABEKMHOPCTXYaeopcyxijskmtvëËïÏ"
CYRILLIC_OUT = "АВЕКМНОРСТХУаеорсухіјѕкмтѵёЁїЇ"
LATIN_IN_GREEK, GREEK_OUT = "ABEZHIKMNOPTYXaeikvoptuxnwyáíóúÁÉÓÍ", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχηωγάίόύΆΈΌΊ"

#: Accented Latin letters with doubles elsewhere: they do not decide a word's alphabet.
ALIKE_ACCENTED = "áíóúÁÉÓÍëËïÏ"

_RUN = r"[\p{L}\p{M}]+"
_CLASSES = {"Latin": r"\p{Latin}", "Cyrillic": r"\p{Cyrillic}", "Greek": r"\p{Greek}", "Armenian": r"\p{Armenian}"}
_LATIN_BASIC = r"[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _mixed(run: str) -> str:
    """True for a run of letters with letters of at least two of the four alphabets."""
    has = [f"regexp_matches({run}, {_quoted(_LATIN_BASIC if n == 'Latin' else c)})::INT" for n, c in _CLASSES.items()]
    return f"({' + '.join(has)}) > 1"


def _count(run: str, cls: str) -> str:
    return f"len(regexp_replace({run}, {_quoted('[^' + cls.strip('[]') + ']')}, '', 'g'))"


def plain_sql(column: str) -> str:
    """DuckDB expression for the plain form of a text column."""
    expr = f"translate({column}, {_quoted(FULL_WIDTH + HALF_KANA + WIDE_SIGNS)}, {_quoted(HALF_ASCII + FULL_KANA + PLAIN_SIGNS)})"
    for sign, letters in SIGNS.items():
        expr = f"replace({expr}, {_quoted(sign)}, {_quoted(letters)})"
    # looked up character by character, where there are any
    others = "[" + "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in LIGATURE_RANGES) + "]"
    table = "MAP {" + ", ".join(f"{_quoted(c)}: {_quoted(k)}" for c, k in OTHER_SIGNS.items()) + "}"
    looked_up = f"array_to_string(list_transform(string_split({column}, ''), lambda c: coalesce({table}[c], c)), '')"
    expr = expr.replace(f"translate({column},", f"translate(CASE WHEN regexp_matches({column}, {_quoted(others)}) THEN {looked_up} ELSE {column} END,", 1)
    expr = f"regexp_replace({expr}, {_quoted(INVISIBLE)}, '', 'g')"
    expr = f"regexp_replace({expr}, {_quoted(SPACES)}, ' ', 'g')"
    expr = f"nfc_normalize({expr})"
    latin = f"translate(w, {_quoted(ALIKE_OTHER)}, {_quoted(ALIKE_LATIN)})"
    cyrillic = f"translate(w, {_quoted(LATIN_IN)}, {_quoted(CYRILLIC_OUT)})"
    greek = f"translate(w, {_quoted(LATIN_IN_GREEK)}, {_quoted(GREEK_OUT)})"
    # the alphabet with letters no other alphabet imitates decides; Latin if all letters have doubles
    own = {
        "l": _count(f"translate(w, {_quoted(ALIKE_ACCENTED)}, '')", "[b-df-hj-nq-suvwzBDFGJLNQRSUVWZ\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}]"),
        "c": _count("w", "[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийлнптфцчшщъыьэюяё]"),
        "g": _count("w", "[ΓΔΘΛΞΠΣΦΨΩβγδζηθλμξπρσςφψωάέήίόύώ]"),
    }
    run = (
        f"CASE WHEN NOT ({_mixed('w')}) THEN w WHEN {own['c']} > {own['l']} AND {own['c']} >= {own['g']} THEN {cyrillic} "
        f"WHEN {own['g']} > {own['l']} THEN {greek} ELSE {latin} END"
    )
    pieces = _quoted(f"{_RUN}|[^\\p{{L}}\\p{{M}}]+")
    return f"(SELECT array_to_string(list_transform(regexp_extract_all(v, {pieces}), lambda w: {run}), '') FROM (SELECT {expr} AS v))"


def _clean(value: str) -> str:
    """ASCII without control spaces is plain already; the long expression runs on the rest only."""
    return f"CASE WHEN regexp_full_match({value}, '[\\x20-\\x7E]*') THEN {value} ELSE {plain_sql(value)} END"


def _duckdb_partition(fields: list[str]):
    select = ", ".join(f'{_clean(_ident(f))} AS "{f}__plain"' for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch]))
            out = con.sql(f"SELECT *, {select} FROM part")
            done = out.to_arrow_table() if hasattr(out, "to_arrow_table") else out.fetch_arrow_table()
            yield from done.cast(_schema(batch.schema, fields)).to_batches()
            con.unregister("part")

    return run


def _ident(f: str) -> str:
    return '"' + f.replace('"', '""') + '"'


def _schema(schema: pa.Schema, fields: list[str]) -> pa.Schema:
    for f in fields:
        schema = schema.append(pa.field(f"{f}__plain", pa.string()))
    return schema


def plain_forms(rows: DataFrame, id_col: str, fields: Iterable[str]) -> DataFrame:
    """One consistent form of every text cell: id, field, value, plain.

    Compatibility forms (full and half width, ligatures, Roman numeral signs), letters and marks kept apart,
    invisible characters, other spaces and look-alike letters inside words of mixed alphabet are replaced; quotes,
    dashes, ordinal signs, fractions and whole words of any script stay. NULL stays NULL, '' stays ''. Texts are taken
    whole, whatever their length; equal rows give equal rows. Other columns of ``rows``
    are left out, so their names cannot clash.
    """
    fields = list(fields)
    names = [f"f{i}" for i in range(len(fields))]
    slim = rows.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)])
    schema = ", ".join([f"id {dict(slim.dtypes)['id']}", *(f"{n} string" for n in names), *(f"{n}__plain string" for n in names)])
    done = spread(slim).mapInArrow(_duckdb_partition(names), schema)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).alias("value"), F.col(f"{n}__plain").alias("plain")) for f, n in zip(fields, names)])
    return done.select("id", F.explode(cells).alias("c")).select("id", "c.field", "c.value", "c.plain")


def mixed_word(c: str) -> Column:
    """True where a run of letters still mixes the four alphabets: stray letters without a known double."""
    names = ("Latin", "Cyrillic", "Greek", "Armenian")
    pattern = "|".join(rf"\p{{Is{a}}}[\p{{L}}\p{{M}}]*[{''.join(rf'\p{{Is{b}}}' for b in names if b != a)}]" for a in names)
    return F.regexp_replace(c, "[ªº]", ".").rlike(pattern)


FIELDS = ("filepath", "title", "artist")


def plain(spark, sf_dir: str) -> DataFrame:
    """p1_plain: the plain form of every path, title and artist."""
    return plain_forms(spark.read.parquet(f"{sf_dir}/tracks.parquet"), "id", FIELDS)


def found(spark, sf_dir: str) -> DataFrame:
    """p1_found: values not in plain form that are not garbled (problem 3), which are cases there."""
    tracks = spark.read.parquet(f"{sf_dir}/tracks.parquet").select("id", *dict.fromkeys((*FIELDS, *encoding.FIELDS)))
    changed = plain_forms(tracks, "id", FIELDS).filter((F.col("value") != F.col("plain")) | mixed_word("plain"))
    garbled = encoding.restore_values(tracks, encoding.FIELDS).select("value").withColumn("is_text", F.lit(True))
    return changed.withColumn("is_text", F.col("field") != "filepath").join(garbled, ["value", "is_text"], "left_anti").select("id", "field")
