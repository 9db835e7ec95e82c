"""Quasi-identifiers (QIs): from model replies and from patterns, validated and deduplicated.

A QI is (qi_type, raw_value, normalized_value, confidence, start_pos, end_pos, method). Both
extractors give an array column, so no row leaves its place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.constants import AGE_PATTERNS, AGE_RULES, DOB_PATTERNS, GENDERS, OCCUPATION_CONTEXT, OCCUPATIONS, QI_TYPES, STATE_ROWS, STOP_WORDS, ZIP_CONTEXT, ZIP_STATE
from . import gazetteer

QI = "struct<qi_type:string,raw_value:string,normalized_value:string,confidence:double,start_pos:int,end_pos:int,method:string>"
NONE = "array<" + QI + ">"


def _none() -> Column:
    return F.expr(f"CAST(array() AS {NONE})")


def _qi(kind: str | Column, raw: Column, norm: Column, confidence: float | Column, start: Column, end: Column, method: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(kind).alias("qi_type"), raw.alias("raw_value"), norm.alias("normalized_value"), lit(confidence).alias("confidence"),
        start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), F.lit(method).alias("method"),
    )


# ---- model replies


def prompt(text: Column) -> Column:
    """The request to a model for one text."""
    head = "List the quasi-identifiers of the text as JSON: {\"quasi_identifiers\":[{\"type\",\"raw_value\",\"normalized_value\",\"confidence\"}]}. Types: "
    return F.concat(F.lit(head + ", ".join(QI_TYPES) + ".\nText:\n"), text)


def braces(reply: Column) -> Column:
    """The reply from its first { to its last }; empty without both."""
    return F.regexp_extract(F.trim(reply), r"(?s)\{.*\}", 0)


def parse_reply(reply: Column) -> Column:
    """The items of a reply as variants; what can't be parsed has none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(braces(reply)), "$.quasi_identifiers", "array<variant>"), F.array().cast("array<variant>"))


def field(item: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def find_span(text: Column, raw: Column) -> tuple[Column, Column]:
    """First place of the value, or else of the value in any case, or else (0, 0)."""
    exact, loose = F.instr(text, raw), F.instr(F.lower(text), F.lower(raw))
    at = F.when(exact > 0, exact).otherwise(loose)
    return F.greatest(at - 1, F.lit(0)), F.when(at > 0, at - 1 + F.length(raw)).otherwise(0)


def validate(text: Column, items: Column) -> Column:
    """QIs of parsed items: known types whose value stands in the text. An item that isn't an object
    empties the row, and so does an item of a known type whose value or normalized value isn't a
    string or whose confidence isn't a number."""
    shape = lambda i, name: F.coalesce(F.schema_of_variant(field(i, name, "variant")), F.lit("absent"))
    nested = lambda kind: F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    known = lambda i: F.coalesce(field(i, "type").isin(*QI_TYPES), F.lit(False))
    stood = lambda raw: (F.length(raw) > 0) & F.contains(F.lower(text), F.lower(raw))

    def number(i: Column) -> Column:
        kind = shape(i, "confidence")
        return F.when(kind == "absent", 0.5).when(kind == "BOOLEAN", field(i, "confidence", "boolean").cast("int").cast("double")).otherwise(field(i, "confidence").try_cast("double"))

    def odd(i: Column) -> Column:
        norm = ~shape(i, "normalized_value").isin("absent", "STRING") & F.coalesce(stood(field(i, "raw_value")), F.lit(False))
        return number(i).isNull() | ~shape(i, "raw_value").isin("absent", "STRING") | norm

    bad = F.exists(items, lambda i: ~F.startswith(F.coalesce(F.schema_of_variant(i), F.lit("VOID")), F.lit("OBJECT")) | nested(shape(i, "type")) | (known(i) & odd(i)))
    plain = F.transform(F.filter(items, known), lambda i: F.struct(field(i, "type").alias("type"), F.coalesce(field(i, "raw_value"), F.lit("")).alias("raw"), field(i, "normalized_value").alias("norm"), number(i).alias("confidence")))
    stands = F.filter(plain, lambda i: stood(i["raw"]))

    def made(i: Column) -> Column:
        start, end = find_span(text, i["raw"])
        norm = F.trim(F.lower(F.coalesce(i["norm"], i["raw"])))
        return _qi(i["type"], i["raw"], norm, F.least(F.greatest(i["confidence"], F.lit(0.0)), F.lit(1.0)), start, end, "model")

    return F.when(bad, _none()).otherwise(F.transform(stands, made))


def dedup(qis: Column, by_method: str | None = None) -> Column:
    """One QI for each (type, normalized value): the most confident, or the first of the preferred
    method, ties to the first; in order of first appearance. One fold over the array, which stands
    once in the expression."""
    rank = "{}.confidence" if by_method is None else f"({{}}.method = {folds.literal(by_method)})"
    same = "(a.qi_type = q.qi_type AND a.normalized_value = q.normalized_value)"
    better = f"transform(kept, a -> CASE WHEN {same} AND {rank.format('q')} > {rank.format('a')} THEN q ELSE a END)"
    step = f"(kept, q) -> CASE WHEN exists(kept, a -> {same}) THEN {better} ELSE concat(kept, array(q)) END"
    return folds.fold(qis, f"CAST(array() AS {NONE})", step, "kept -> kept")


# ---- patterns

_MATCH, _PART = "\ufdd0", "\ufdd1"  # code points that no text may hold


def _one_of(words, any_case: bool = True) -> str:
    """A pattern of whole words, which finds what the alternatives in their order find. Where they are plain, those
    of one first letter stand together behind a look at that letter, so most places of a text are passed at once."""
    flag, groups = "(?i)" if any_case else "", {}
    for w in words:
        groups.setdefault(w[:1].lower() if any_case else w[:1], []).append(w[1:])
    if not all(re.fullmatch("[A-Za-z][A-Za-z ]*", w) for w in words):
        return f"{flag}\\b({'|'.join(words)})\\b"
    return f"{flag}(?=[{''.join(groups)}])\\b({'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in groups.items())})\\b"


def _from(letters: str, pattern: str) -> str:
    """The pattern, which begins with one of these, behind a look at the first: most places of a text are passed at
    once, where the pattern alone would try a word's bound and every alternative."""
    return f"(?i)(?=[{letters}]){pattern}"


def _found(text: Column, pattern: str, kind: str, confidence: float, method: str, norm: str = "{}", span: str = "match") -> Column:
    """QIs of a pattern, normalized from its first group by `norm`, SQL text in which {} stands for the
    group. The pattern runs over the text once: marks go round each match, and the pieces between marks
    give the places. `span` is "match", or "group" for the place of the first group, which must be the
    first of its kind in the match; with "group in match" the raw value is the whole match all the same."""
    marked = F.regexp_replace(folds.without(text, _MATCH + _PART), F.lit(pattern), F.lit(f"{_MATCH}$0{_PART}$1{_PART}"))
    pieces = f"transform(split(m, '{_MATCH}'), x -> split(x, '{_PART}'))"
    whole, group, rest = ("get(p, 0)", "get(p, 1)", "get(p, 2)")
    begin = "a.at" if span == "match" else f"a.at + instr({whole}, {group}) - 1"
    end = f"{begin} + length({whole if span == 'match' else group})"
    fields = {"qi_type": folds.literal(kind), "raw_value": group if span == "group" else whole, "normalized_value": norm.format(group), "confidence": f"{confidence!r}D", "start_pos": begin, "end_pos": end, "method": folds.literal(method)}
    one = f"named_struct({', '.join(f"'{name}', {value}" for name, value in fields.items())})"
    step = f"""(a, p) -> CASE WHEN size(p) < 3 THEN named_struct('at', a.at + length({whole}), 'found', a.found)
        ELSE named_struct('at', a.at + length({whole}) + length({rest}), 'found', concat(a.found, array({one}))) END"""
    all_ = f"aggregate({pieces}, named_struct('at', 0, 'found', CAST(array() AS {NONE})), {step}, a -> a.found)"
    # most texts hold no match: they are told by the marks, without a fold
    return F.get(folds.each(F.array(marked), f"m -> CASE WHEN contains(m, '{_MATCH}') THEN {all_} ELSE CAST(array() AS {NONE}) END"), F.lit(0))


# What stands in the end of a told occupation and doesn't belong to it.
_STOPS = f"(?i)(^|\\s+)((?:{'|'.join(STOP_WORDS)})[.,;:]*\\s*)+$"
_ONE_BLANK = f"trim(regexp_replace({{}}, {folds.literal(r'\s+')}, ' '))"
_TRIMMED = f"regexp_replace(trim(regexp_replace({_ONE_BLANK}, {folds.literal(_STOPS)}, '')), '[.,;:]+$', '')"
_YEARS = "coalesce(CAST(try_cast({0} AS int) AS string), {0})"  # without leading zeros


def trim_capture(value: Column) -> Column:
    """Without stop words and punctuation at the end, words one blank apart; empty if nothing else
    is there."""
    one = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.regexp_replace(F.trim(F.regexp_replace(one, _STOPS, "")), "[.,;:]+$", "")


def _lived(qis: Column) -> Column:
    return folds.keep(qis, "q -> try_cast(q.normalized_value AS int) BETWEEN 0 AND 120")


def ages(text: Column) -> Column:
    return _lived(F.concat(*(_found(text, _from(first, p), "age", 0.9, "pattern", _YEARS) for first, p in zip((r"\d", "a", r"\d", "1-9"), AGE_PATTERNS, strict=True))))


def told_ages(text: Column) -> Column:
    """Ages by the token rules of a named-entity recognizer."""
    return _lived(_found(text, _from("0-9a", AGE_RULES.removeprefix("(?i)")), "age", 0.9, "ner", _YEARS.replace("{0}", "regexp_extract({0}, '[0-9]+', 0)")))


def births(text: Column) -> Column:
    return F.concat(*(_found(text, _from("db", p), "date_of_birth", 0.95, "pattern") for p in DOB_PATTERNS))


def zips(text: Column) -> Column:
    """ZIPs in context, then those after a state that the context didn't give."""
    near = _found(text, _from("zpalr", ZIP_CONTEXT), "zip_code", 0.95, "pattern", span="group")
    seen = folds.each(near, "q -> q.normalized_value")
    return F.concat(near, F.filter(_found(text, f"(?=[A-Z]){ZIP_STATE}", "zip_code", 0.9, "pattern", span="group in match"), lambda q: ~F.array_contains(seen, q["normalized_value"])))


def _by_name(table: dict[str, str]) -> str:
    return f"try_element_at(map({', '.join(folds.literal(x) for pair in table.items() for x in pair)}), lower({{}}))"


def genders(text: Column) -> Column:
    return _found(text, _from("mfwbg", r"\b(male|female|man|woman|boy|girl)\b"), "gender", 0.95, "ner", _by_name(GENDERS))


def named_occupations(text: Column) -> Column:
    return _found(text, _one_of(OCCUPATIONS), "occupation", 0.85, "phrase", "lower({})")


def told_occupations(text: Column) -> Column:
    """What stands where an occupation is told."""
    told = F.concat(*(_found(text, _from(first, p), "occupation", 0.8, "pattern", f"lower({_TRIMMED})") for first, p in zip(("weojpcr", "i"), OCCUPATION_CONTEXT, strict=True)))
    bare = F.transform(told, lambda q: q.withField("raw_value", F.trim(q["raw_value"])))
    return folds.keep(bare, "q -> length(q.normalized_value) >= 3")


def occupations(text: Column) -> Column:
    return F.concat(named_occupations(text), told_occupations(text))


def states(text: Column) -> Column:
    """Upper-case abbreviations and names of states, as names."""
    short = _by_name({a: name for a, name, _ in STATE_ROWS})
    names = sorted((name for _, name, _ in STATE_ROWS), key=len, reverse=True)
    codes = [a.upper() for a, _, _ in STATE_ROWS]
    return F.concat(
        _found(text, _one_of(names), "location", 0.85, "ner", "lower({})"),
        _found(text, _one_of(codes, any_case=False), "location", 0.85, "ner", short),
    )


def terms(text: Column, kind: str, words: list[str], confidence: float = 0.9, method: str = "ner") -> Column:
    """Entries of a dictionary, such as diseases, places or peoples."""
    return _found(text, _one_of(words), kind, confidence, method, "lower({})")


def of_dictionary(found: Column, kinds: tuple[str, ...], method: str = "ner") -> Column:
    """QIs of a gazetteer's spans of these types, the first and longest of those that overlap."""
    mine = gazetteer.longest(F.filter(found, lambda s: s["kind"].isin(*kinds)))
    return F.transform(mine, lambda s: _qi(s["kind"], s["text"], s["value"], s["confidence"], s["start"], s["end"], method))


def recognized(text: Column, places: list[str] | None = None, peoples: list[str] | None = None, found: Column | None = None) -> Column:
    """What a general named-entity recognizer would give, in the order of the text: states, other
    places, peoples, genders, ages. `found` has a gazetteer's places and peoples."""
    parts = [states(text), genders(text), told_ages(text)]
    if places:
        parts.append(terms(text, "location", places, 0.7))
    if peoples:
        parts.append(terms(text, "ethnicity", peoples, 0.7))
    if found is not None:
        parts += [of_dictionary(found, ("location",)), of_dictionary(found, ("ethnicity",))]
    keyed = folds.each(F.concat(*parts), "q -> named_struct('a', q.start_pos, 'b', q.end_pos, 'c', q.qi_type, 'q', q)")
    return folds.each(folds.ordered(keyed), "k -> k.q")


def extract(
    df: DataFrame, text: str = "text", diseases: list[str] | None = None, peoples: list[str] | None = None, places: list[str] | None = None, out: str = "qis", recognizer=None, dictionary: DataFrame | None = None
) -> DataFrame:
    """All extractors in order, deduplicated with what a recognizer found first. `recognizer` is a
    function of the text column that stands in for `recognized`, such as a pandas UDF. `dictionary` is a
    gazetteer's table (term, kind, value, confidence) with QI types as kinds; its occupations stand in
    for the named ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = None
    if dictionary is not None:
        df = df.withColumn("_found", gazetteer.spans(t, dictionary))
        found = F.col("_found")
    general = recognizer(t) if recognizer else recognized(t, places, peoples, found)
    sick = [terms(t, "disease", diseases, method="dictionary")] if diseases else []
    if found is not None:
        sick.append(of_dictionary(found, ("disease",), "dictionary"))
    named = named_occupations(t) if found is None else of_dictionary(found, ("occupation",), "phrase")
    parts = [general, *sick, named, told_occupations(t), ages(t), births(t), zips(t)]
    return df.withColumn("_all", F.concat(*parts)).withColumn(out, dedup(F.col("_all"), "ner")).drop("_all", "_found")


def from_replies(df: DataFrame, replies: DataFrame, text: str = "text", out: str = "qis") -> DataFrame:
    """QIs of recorded replies (text_hash, reply), found by the SHA-256 of the text; a text without
    a reply has none. Of several replies to one text the greatest counts."""
    told = replies.groupBy(F.col("text_hash").alias("_h")).agg(F.max("reply").alias("_reply"))
    keyed = df.withColumn("_h", F.sha2(F.col(text), 256)).join(told, "_h", "left")
    found = keyed.withColumn("_items", parse_reply(F.col("_reply")))
    return found.withColumn(out, dedup(validate(F.col(text), F.col("_items")))).drop("_h", "_reply", "_items")


def to_json(qis: Column) -> Column:
    return F.to_json(qis)


def from_json(value: Column) -> Column:
    return F.from_json(value, NONE)
