"""Reading of identifiers and vocabulary words that are written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII forms and the Cyrillic letters that look like Latin ones.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_PLAIN = "".join(chr(0x21 + i) for i in range(94))
_CYRILLIC = "АВСЕНКМОРТХаеорсх"
_LATIN = "ABCEHKMOPTXaeopcx"

# Words that name a rank or a tier and words that introduce a number.
RANK_WORDS = ("superkingdom", "domain", "kingdom", "phylum", "class", "order", "family", "genus", "tier", "rank")
_NUMBER_WORDS = "nr|no|num|number"

_THREE_GROUPS = r"(?:[0-9o]{1,3}[^0-9a-z.]){2}[0-9o]{3}(?![0-9])"
_ACCESSION_NUMBER = rf"(?:gc[af]|assembly|accession)[^0-9a-z]*({_THREE_GROUPS}|[0-9o]+)"


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but white space (of any script)."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def visible(c: Column) -> Column:
    """Without invisible format characters, full-width and look-alike letters made plain, in lower case."""
    plain = F.translate(F.regexp_replace(c, r"\p{Cf}", ""), _WIDE + _CYRILLIC, _PLAIN + _LATIN)
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c))


def accession_text(c: Column) -> Column:
    """An accession for equality by text: outer blanks, tabs and line feeds dropped, lower case; null if nothing is left."""
    trimmed = F.lower(F.btrim(c, F.lit(" \t\n")))
    return F.when(trimmed != "", trimmed)


def _unzeroed(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def genome_key(c: Column) -> Column:
    """The genome that an id names: ``acc:<number>`` or ``set:<name>:<number>``; null for a blank id.

    Ids with the same accession number, or the same name and number, get the same key. Prefix, version,
    separators inside numbers, leading zeros, the letter O for zero, quotes, remarks, invisible and
    full-width characters make no difference. Anything else is compared by its letters and digits.
    """

    def read(s: Column) -> Column:
        number = F.regexp_extract(s, _ACCESSION_NUMBER, 1)
        named = F.regexp_replace(s, rf"(?<=\S)\s*[\(\[].*$|(?<![a-z])(?:{_NUMBER_WORDS})(?![a-z])", "")

        def key(v: Column) -> Column:
            digits = _unzeroed(F.translate(F.regexp_replace(v["number"], "[^0-9o]", ""), "o", "0"))
            name = F.regexp_replace(v["named"], "[^a-z]", "")
            count = _unzeroed(F.regexp_extract(v["named"], "([0-9]+)", 1))
            bare = F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")
            return (
                F.when(s.rlike(r"(?U)^\s*$"), F.lit(None).cast("string"))
                .when(v["number"] != "", F.concat(F.lit("acc:"), digits))
                .when((name != "") & (count != ""), F.concat(F.lit("set:"), name, F.lit(":"), count))
                .otherwise(F.concat(F.lit("raw:"), F.when(bare == "", F.trim(s)).otherwise(bare)))
            )

        return F.get(F.transform(F.array(F.struct(number.alias("number"), named.alias("named"))), key), F.lit(0))

    # Plain writings are read by two expressions. The general reading is a lambda, which keeps it out of the generated
    # method: with it, that grows beyond what the JVM compiles, and every row pays for it.
    return (
        F.when(c.rlike(r"^GC[AF]_[0-9]{9}(\.[0-9]+)?$"), F.concat(F.lit("acc:"), _unzeroed(F.substring(c, 5, 9))))
        .when(c.rlike(rf"^(?!.*(?:gc[af]|assembly|accession|_(?:{_NUMBER_WORDS})_))[a-z]+_[a-z]+_[1-9][0-9]*$"), F.regexp_replace(c, "^([a-z]+)_([a-z]+)_", "set:$1$2:"))
        .when(c.isNull(), F.lit(None).cast("string"))
        .otherwise(F.get(F.transform(F.array(visible(c)), read), F.lit(0)))
    )


def word_key(c: Column) -> Column:
    """A role, label, tier, group or source with all manner of writing removed; null if nothing is left.

    Letter case, spacing, punctuation, invisible characters, a rank or tier word and a remark in brackets
    are dropped. Where the brackets hold all there is, their content counts.
    """
    seen = visible(c)
    bare = F.regexp_replace(seen, r"[\(\[][^\)\]]*[\)\]]", " ")
    s = F.when(bare.rlike(r"[\p{L}\p{N}]"), bare).otherwise(seen)
    s = F.regexp_replace(s, r"^[^\p{L}\p{N}]*[dkpcofgs]__", "")
    s = F.regexp_replace(s, rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(RANK_WORDS)})(?![\p{{L}}\p{{N}}])", "")
    return F.nullif(F.regexp_replace(s, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def tier_key(c: Column) -> Column:
    """``A``, ``B``, ``C``, or null for anything else."""
    return F.nullif(F.regexp_extract(F.upper(word_key(c)), "^([ABC])$", 1), F.lit(""))


def group_key(c: Column) -> Column:
    """The taxonomy group, or null where it is blank or unclassified."""
    return F.nullif(word_key(c), F.lit("unclassified"))


def text_tokens(c: Column) -> Column:
    """Size in tokens of the ByT5 tokenizer without special tokens: the bytes of the UTF-8 text, 0 for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
