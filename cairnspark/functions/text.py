"""Text functions as column expressions: normal forms, tokens, stems, terms,
identifiers, truncation and JSON repair."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The term pattern, stop words and ordered suffixes of the search.
TERM_PATTERN = "[a-zA-Zа-яА-ЯёЁ_]{2,}"
STOP_WORDS = (
    "и", "в", "во", "на", "по", "для", "к", "ко", "с", "со", "о", "об", "от", "до", "из", "за", "при", "или",
    "изменить", "изменения", "изменение", "добавить", "сделать", "обновить", "заменить", "создать",
    "поменять", "нужно", "нужен", "нужна", "должен", "должна", "надо", "русский", "русском", "русскоязычным", "язык",
)
SUFFIXES = (
    "иями", "ями", "ами", "ение", "ений", "ению", "ения", "ениям", "овать", "ание", "ании", "ания", "ить", "ать", "ять", "ться",
    "ости", "ость", "ого", "ому", "ыми", "ими", "ой", "ий", "ый", "ая", "ое", "ые", "ых", "ую", "ам", "ом", "ем", "ов", "ев",
    "ие", "ия", "ию", "ей", "ям", "ах", "ях", "ет", "ют", "ут", "ан", "ен", "ти", "ть", "иям", "иях",
    "а", "я", "ы", "и", "у", "ю", "о", "е",
)
REFERENCE_TERM_PATTERN = "[a-zA-Zа-яА-ЯёЁ_]{3,}"
REFERENCE_STOP_WORDS = ("изменить", "сделать", "использовать")
LEAST_STEM = 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Signs whose folded form is not their small one, worked out from Python's
#: tables for the first plane: those that fold to one sign, and to several.
_folds = {c: c.casefold() for c in map(chr, [*range(128, 0xD800), *range(0xF900, 0xFFFF)]) if c.casefold() != c.lower() and c.lower() == c}
_one = {c: f for c, f in _folds.items() if len(f) == 1}
_many = {c: f for c, f in _folds.items() if len(f) > 1}


def _ranges(signs) -> str:
    """A pattern of the signs, neighbours as ranges."""
    codes, runs = sorted(map(ord, signs)), []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_several = _ranges(_many)
#: Signs that fold but ё and ß. What is ASCII is passed over at once.
_rare = r"(?=[^\x00-\x7f])" + _ranges((_one | _many).keys() - {"ß"})


def normalise(c: Column | str) -> Column:
    """Case-folded, with ё as е. Signs that fold to one other are translated
    at once; only texts that hold a sign that folds to several (ligatures and
    the like) are taken apart sign by sign, ASCII texts are not looked at
    again, and in texts without rare signs only ё and ß are replaced."""
    small = F.lower(_col(c))
    plain = F.translate(small, "ё" + "".join(_one), "е" + "".join(_one.values()))
    table = F.create_map(*[F.lit(x) for kv in _many.items() for x in kv])
    apart = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(F.octet_length(small) == F.length(small), small).when(~small.rlike(_rare), F.replace(F.replace(small, F.lit("ё"), F.lit("е")), F.lit("ß"), F.lit("ss"))).when(plain.rlike(_several), apart).otherwise(plain)


def tokens(c: Column | str, pattern: str = TERM_PATTERN) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({pattern})"), F.lit(1))


def stem(c: Column | str) -> Column:
    """A word, folded, without the first suffix of the list that leaves four
    letters."""
    # through an array, so that the folding stands in the plan once
    return F.get(F.transform(F.array(normalise(c)), folded_stem), F.lit(0))


def folded_stem(w: Column) -> Column:
    """``stem`` of a word that is folded already."""
    fits = F.filter(F.array(*[F.lit(x) for x in SUFFIXES]), lambda x: F.endswith(w, x) & (F.length(w) - F.length(x) >= LEAST_STEM))
    return F.substring(w, F.lit(1), F.length(w) - F.coalesce(F.length(F.get(fits, F.lit(0))), F.lit(0)))


def stem_sql(word: str) -> str:
    cases = " ".join(f"when {word} like '%{s}' and length({word}) >= {len(s) + LEAST_STEM} then left({word}, length({word}) - {len(s)})" for s in SUFFIXES)
    return f"case {cases} else {word} end"


def query_terms(c: Column | str) -> Column:
    """Sorted distinct tokens but stop words, with the stems of long ones."""
    kept = F.filter(F.array_distinct(tokens(normalise(c))), lambda t: ~t.isin(*STOP_WORDS))
    stems = F.transform(F.filter(kept, lambda t: F.length(t) >= LEAST_STEM), folded_stem)
    return F.array_sort(F.array_union(kept, F.filter(stems, lambda t: t != "")))


def rooted(terms: Column) -> Column:
    """Terms with their stems, for matching: array<struct<term, root>>."""
    return F.transform(terms, lambda t: F.struct(t.alias("term"), folded_stem(t).alias("root")))


def plain_stem(word: str) -> str:
    """``stem`` of one word, for a query that is known when the plan is made."""
    word = word.casefold().replace("ё", "е")
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= LEAST_STEM), word)


def plain_terms(query: str) -> list[tuple[str, str]]:
    """``query_terms`` of such a query, each with its stem."""
    folded = query.casefold().replace("ё", "е")
    kept = {t for t in re.findall(TERM_PATTERN, folded) if t not in STOP_WORDS}
    return [(t, plain_stem(t)) for t in sorted(kept | {plain_stem(t) for t in kept if len(t) >= LEAST_STEM} - {""})]


def reference_terms(c: Column | str) -> Column:
    """Terms of the reference library, repeats included."""
    return F.filter(tokens(F.lower(_col(c)), REFERENCE_TERM_PATTERN), lambda t: ~t.isin(*REFERENCE_STOP_WORDS))


def meaningful_tokens(c: Column | str, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= least) & (~t.isin(*stop) if stop else F.lit(True))))


def match_kind(term: Column, root: Column, field: Column, field_tokens: Column) -> Column:
    """exact_token, substring, stem or null."""
    return F.when(F.contains(field, term), F.when(F.array_contains(field_tokens, term), "exact_token").otherwise("substring")).when((root != "") & F.contains(field, root), "stem")


def identifier_tokens(c: Column | str) -> Column:
    """Lower-case parts of an identifier, cut at other signs, camel humps and
    digits; distinct."""
    humps = F.regexp_replace(F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])|([0-9])([A-Za-z])", "$1$3 $2$4")
    return F.array_distinct(F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda t: t != ""))


def humanised(c: Column | str) -> Column:
    return F.trim(F.translate(_col(c), "_-", "  "))


def collapsed(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def slug(c: Column | str, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), 1, most)


def collection_name(prefix: str, key: Column | str) -> Column:
    return F.concat_ws("_", F.lit(prefix), slug(key), F.substring(F.sha1(_col(key)), 1, 8))


def truncated(c: Column | str, limit: int, marker: str = "\n# ... truncated ...", spare: int = 16) -> Column:
    """The first ``limit - spare`` characters, right-trimmed, and the marker;
    a limit of 0 or less, or a short text, changes nothing."""
    col = _col(c)
    if limit <= 0:
        return col
    cut = F.regexp_replace(F.substring(col, 1, max(0, limit - spare)), r"\s+$", "")
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(cut, F.lit(marker)))


def ellipsis(c: Column | str, limit: int) -> Column:
    """The other truncation: three characters spared for an ellipsis."""
    return truncated(c, limit, "...", 3)


def truncated_source(c: Column | str, limit: int) -> Column:
    """As long as ``limit`` with a suffix that tells the full length."""
    col = _col(c)
    suffix = F.concat(F.lit("\n# ... truncated, original_chars="), F.length(col).cast("string"))
    return F.when((F.lit(limit) <= 0) | (F.length(col) <= limit), col).otherwise(F.concat(F.substring(col, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.length(suffix))), suffix))


def signature(source: Column | str, lines: int = 4) -> Column:
    """The first useful lines of a definition, up to the one that ends in a
    colon, joined by blanks."""
    useful = F.slice(F.filter(F.transform(F.split(_col(source), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("@")), 1, lines)
    ends = F.array_position(F.transform(useful, lambda x: x.endswith(":")), True)
    return F.array_join(F.when(ends > 0, F.slice(useful, F.lit(1), ends.cast("int"))).otherwise(useful), " ")


def line_slice(source: Column | str, start: Column, end: Column) -> Column:
    """Lines start..end of a text, counted from one."""
    return F.array_join(F.slice(F.split(_col(source), "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def safe_double(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string").try_cast("double"), F.lit(0.0))


def duration_text(ms: Column | str) -> Column:
    """12.3s under a minute, else 2m 5s. Tenths are those of the seconds as a
    double: its exact value decides at a half, and an exact half goes to the
    even tenth."""
    c = _col(ms).cast("long")
    size = F.abs(c)
    # the double times 2^57 is a whole number under 2^63; both sides are exact
    held = (size / F.lit(1000.0) * F.lit(float(1 << 57))).try_cast("long").cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")
    true = size.cast("decimal(10,0)") * F.lit(1 << 57).cast("decimal(18,0)")
    tenths, rest = F.floor(size / 100), size % 100
    up = (rest > 50) | ((rest == 50) & ((held > true) | ((held == true) & (tenths % 2 == 1))))
    tenths = tenths + F.when(up, 1).otherwise(0)
    short = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    return F.when((c < 60000) & (c > -60000), short).otherwise(F.format_string("%dm %ds", F.floor(c / 60000), F.floor(F.pmod(c, F.lit(60000)) / 1000)))


def fence_stripped(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def trailing_commas_gone(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r",\s*([}\]])", "$1")


def missing_commas_added(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r'(["}\]0-9el])\s*\n(\s*"[A-Za-z_]+"\s*:)', "$1,\n$2")


def plain_quotes(c: Column | str) -> Column:
    return F.translate(_col(c), "“”’", "\"\"'")


def type_name(c: Column | str) -> Column:
    """A type's bare name: no quotes, typing prefix, subscript or module, the
    usual aliases resolved."""
    bare = F.regexp_replace(F.translate(F.trim(_col(c)), "'\"", ""), r"typing\.", "")
    bare = F.element_at(F.split(F.regexp_replace(bare, r"\[.*$", ""), r"\."), -1)
    # Aliases of type names.
    aliases = {
        "DateTime": "datetime", "Datetime": "datetime", "List": "list", "Dict": "dict", "Set": "set", "Tuple": "tuple", "Sequence": "list",
        "MutableSequence": "list", "PathLike": "Path", "PurePath": "Path", "PurePosixPath": "Path", "PureWindowsPath": "Path",
    }
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(table, bare), bare)


def types_fit(expected: Column, actual: Column) -> Column:
    """Unknown types fit, and so do equal ones once aliases are resolved."""
    e, a = type_name(expected), type_name(actual)
    return F.coalesce((e == "") | (a == "") | (e == a), F.lit(True))
