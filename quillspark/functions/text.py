"""Text expressions: built-in Column functions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits that decide results.
MAX_QUERY_TERMS = 8
SNIPPET = 120
DOCUMENT_SNIPPET = 240
CHUNK_CHARS, CHUNK_OVERLAP = 1800, 200


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_query(q: Column) -> Column:
    """Slashes and runs of white space become one space; ends are trimmed."""
    return _strip(F.regexp_replace(F.regexp_replace(q, "/+", " "), r"\s+", " "))


def query_terms(q: Column, most: int = MAX_QUERY_TERMS) -> Column:
    """Distinct terms of two characters or more: the `most` longest (ties by place), in order of place."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(q), F.lit(r"([0-9a-z][0-9a-z&\-]*)"), F.lit(1)), lambda t: F.length(t) >= 2))
    placed = F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("place"), t.alias("term")))
    longest = F.slice(F.array_sort(placed), 1, most)
    back = F.array_sort(F.transform(longest, lambda s: F.struct(s["place"].alias("place"), s["term"].alias("term"))))
    return F.transform(back, lambda s: s["term"])


def strip_markdown(text: Column) -> Column:
    """Without heading, emphasis, code, quote and bracket signs; white space collapsed."""
    return _strip(F.regexp_replace(F.regexp_replace(text, r'[#*_`>\[\]"]', ""), r"\s+", " "))


def _shortened(plain: Column, most: int) -> Column:
    cut = F.regexp_replace(F.substring(plain, 1, most), r"[,.;:\s]+$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("…")))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    plain = strip_markdown(F.coalesce(text, F.lit("")))
    return F.when(plain == "", F.lit("No content")).otherwise(_shortened(plain, most))


def document_snippet(text: Column, most: int = DOCUMENT_SNIPPET) -> Column:
    return _shortened(_strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), most)


def images_to_alt(text: Column) -> Column:
    """Markdown images as their alternative text, "Image" where that is empty."""
    named = F.regexp_replace(text, r"!\[\s*([^\]\s][^\]]*?)\s*\]\([^)]*\)", "$1")
    return F.regexp_replace(named, r"!\[\s*\]\([^)]*\)", "Image")


def html_escape(text: Column) -> Column:
    return _strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))


def first_paragraph(text: Column) -> Column:
    return _strip(F.split(text, "\n\n")[0])


def windows(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` characters that share `overlap` with the next; the last ends the text.  Blank ones are there too, and one null of a null text."""
    n, step = F.length(text), size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step)))
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.substr(text, i * step + 1, F.lit(size)))


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """The windows of a text that are not blank."""
    return F.filter(windows(text, size, overlap), lambda c: _strip(c) != "")


def token_count(text: Column) -> Column:
    return F.when(_strip(text) == "", 0).otherwise(F.size(F.split(_strip(text), r"\s+")))


def path_label(identifier: Column) -> Column:
    """A label of a hierarchy path: other signs become "_", no "_" at the ends, none starts with a digit."""
    label = F.regexp_replace(F.regexp_replace(identifier, "[^A-Za-z0-9]", "_"), "^_+|_+$", "")
    return F.when(label == "", F.concat(F.lit("EMPTY_"), F.substring(F.sha2(identifier, 256), 1, 12))).when(label.rlike("^[0-9]"), F.concat(F.lit("_"), label)).otherwise(label)


def reference_to_internal(ref_id: Column) -> Column:
    return F.translate(ref_id, ":/", "__")


def slug(dataset: Column, identifier: Column) -> Column:
    """The dataset and the letters, digits, hyphens and underscores of an identifier ("doc" without any), 60 signs at most."""
    body = F.regexp_replace(F.regexp_replace(identifier, r"[^\p{L}\p{N}_\-]", ""), "^[-_]+|[-_]+$", "")
    return F.substring(F.concat(dataset, F.lit("_"), F.when(body == "", "doc").otherwise(body)), 1, 60)


def media_segment(name: Column) -> Column:
    """A name as a folder of media: other signs than letters, digits, ".", "_" and "-" become "_"."""
    return F.coalesce(F.nullif(F.regexp_replace(_strip(F.coalesce(name, F.lit(""))), "[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("document"))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def shared_trigrams(text: Column, grams: list[str]) -> Column:
    """How many of `grams` the text has: its words are laid out with their blanks and searched,
    which builds no set of the text's own."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    laid = F.concat(F.lit("  "), F.array_join(words, "   "), F.lit(" "))
    return F.size(F.filter(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: F.contains(laid, g))) if grams else F.lit(0)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def natural_key(text: Column) -> Column:
    """A sort key that orders digit runs by value and ignores case: runs are padded to 12 digits."""
    padded = F.regexp_replace(F.lower(text), "([0-9]+)", "000000000000$1")
    return F.regexp_replace(padded, "0*([0-9]{12})(?![0-9])", "$1")


def plural_variants(term: Column) -> Column:
    """A term with its plural, which its last word forms; only the term where that ends in s or
    is no word.  What follows the last word stays behind it."""
    word, after = F.regexp_extract(term, "([A-Za-z]+)[^A-Za-z]*$", 1), F.regexp_extract(term, "([^A-Za-z]*)$", 1)
    head = F.substr(term, F.lit(1), F.length(term) - F.length(after))
    low = F.lower(word)

    def ending(cut: int, end: str) -> Column:
        return F.concat(F.substr(head, F.lit(1), F.length(head) - cut), F.lit(end), after)

    plural = (
        F.when(low.rlike("(x|z|ch|sh)$"), ending(0, "es"))
        .when(low.rlike("[^aeiou]y$"), ending(1, "ies"))
        .when(low.endswith("fe"), ending(2, "ves"))
        .when(low.endswith("f") & (F.length(low) > 1), ending(1, "ves"))
        .otherwise(ending(0, "s"))
    )
    return F.when((word == "") | low.endswith("s"), F.array(term)).otherwise(F.array(term, plural))


#: How structured references are written, and the kind of what they name.
REFERENCES = {
    "Section": r"(?i)\b(?:s|sect|section)\s*([0-9]+[A-Z]*-[0-9A-Z]+|[0-9]+[A-Z]*)\b",
    "Division": r"(?i)\bdiv(?:ision)?\s*([0-9]+[A-Z]?)\b",
    "Subdivision": r"(?i)\bsubdiv(?:ision)?\s*([0-9]+-[A-Z])\b",
    "Part": r"(?i)\bpart\s*([IVXLCDM]+|[0-9A-Z\-]+)\b",
    "RefId": r"(?i)\b([A-Z][A-Z0-9]{1,10}:\s*(?:Act|Schedule(?::\s*\d+)?|Part|Division|Subdivision|Section|Definition)\s*:\s*[A-Za-z0-9_\-:.]+)\b",
    "LocalId": r"(?i)\b([0-9]+[A-Z]*-[0-9A-Z]+)\b",
}


def structured_references(text: Column) -> Column:
    """All structured references of a text as structs (kind, value), kind by kind, in their order."""
    def of(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(REFERENCES[kind]), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(v, r"\s*:\s*", ":").alias("value")))

    found = map(of, REFERENCES)
    return F.concat(*found)


def minmax(value: Column, low: Column, high: Column, top: float = 100.0) -> Column:
    """`value` scaled to 0..top; the middle where all are equal."""
    return F.when(high <= low, F.lit(top / 2)).otherwise(F.lit(top) * (value - low) / F.nullif(high - low, F.lit(0.0)))


def citation_token(text: Column, default_act: str, acts: list[str]) -> Column:
    """struct(act, section, terms) of a token such as "ACT s 6-5; income", or null."""
    act = F.upper(F.regexp_extract(text, r"(?i)^\s*(" + "|".join(acts) + r")\b", 1))
    rest = _strip(F.regexp_replace(text, r"(?i)^\s*(" + "|".join(acts) + r")\b[\s:,]*", ""))
    marked = F.regexp_extract(rest, r"(?i)^(?:section|sec|s)\.?\s*([0-9]+[a-z]*(?:[-.–— ][0-9]+[a-z]*)*)", 0)
    gap = F.regexp_extract(rest, r"(?i)^([0-9]+[a-z]*\s+[0-9a-z]+)", 0)
    bare = F.regexp_extract(rest, r"(?i)^([0-9]+[a-z]*(?:[-.–—][0-9]+[a-z]*)*)", 0)
    taken = F.when(marked != "", marked).when(gap != "", gap).otherwise(bare)
    section = F.upper(F.regexp_replace(_strip(F.regexp_replace(taken, r"(?i)^(?:section|sec|s)\.?\s*", "")), r"[-.–—\s]+", "-"))
    left = F.substr(rest, F.length(taken) + 1)
    terms = F.filter(F.transform(F.split(left, "[;,]"), _strip), lambda t: t != "")
    return F.when(taken != "", F.struct(F.when(act != "", act).otherwise(F.lit(default_act)).alias("act"), section.alias("section"), terms.alias("terms")))


def term_markers(text: Column) -> Column:
    """Terms that an asterisk marks, sorted: "*term" up to a sign that ends it."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[\s(])\*([a-zA-Z0-9][a-zA-Z0-9\-]*)(?=[\s,.;:)*]|$)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def fallback_markers(text: Column) -> Column:
    """What asterisks mark where no terms are known, as written: from the asterisk to the first blank, stop or end that has
    something before it."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?:^|[\s(])\*([a-zA-Z0-9\s\-()]+?)(?=[\s,.;:)]|$)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != ""))


#: The kinds of headings that have a label of their own, and its short forms.
KINDS = {"act": "Act", "chapter": "Chapter", "part": "Part", "division": "Division", "subdivision": "Subdivision", "section": "Section", "schedule": "Schedule"}
SHORT = {"Chapter": ["Ch"], "Part": ["Pt"], "Division": ["Div"], "Subdivision": ["Subdiv"], "Section": ["Sect", "s"], "Schedule": ["Sch"]}
SCHEDULE_PARTS = ["part", "division", "subdivision", "section"]


def heading_label(kind: Column, title: Column, local_id: Column, ref_id: Column) -> Column:
    """struct(label, variants, heading) of a node: its preferred label, all forms of the label in
    order, and the label joined with the title unless that begins with it.

    `kind` is a type such as "Section" or "Schedule:1:Part"; an identifier that `local_id`
    lacks comes from the reference or the title."""
    identifier = r"(?i)([0-9]+[A-Z]*-[0-9A-Z]+|[0-9]+[A-Z]*|[IVXLCDM]+)"
    name = _strip(F.coalesce(title, F.lit("")))
    segments = F.filter(F.transform(F.split(F.coalesce(kind, F.lit("")), ":"), _strip), lambda x: x != "")
    base = F.lower(F.coalesce(F.get(segments, F.lit(0)), F.lit("")))
    word = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[base]
    tail = F.element_at(F.split(F.coalesce(ref_id, F.lit("")), ":"), -1)
    from_ref = F.when(tail.rlike(identifier), _strip(tail)).otherwise(F.regexp_extract(F.coalesce(ref_id, F.lit("")), identifier, 1))
    own = F.coalesce(F.nullif(_strip(F.coalesce(local_id, F.lit(""))), F.lit("")), F.nullif(from_ref, F.lit("")), F.nullif(F.regexp_extract(name, identifier, 1), F.lit("")), F.lit(""))
    schedule = _strip(F.concat_ws(" ", F.lit("Schedule"), F.get(segments, F.lit(1))))
    brief = F.regexp_replace(schedule, "^Schedule", "Sch")
    last = F.lower(F.when(F.size(segments) > 2, F.element_at(segments, -1)).otherwise(F.lit("")))
    inner = F.when(last.isin(*SCHEDULE_PARTS), F.initcap(last))

    def joined(*parts: Column) -> Column:
        return _strip(F.concat_ws(" ", *parts))

    def forms(w: str) -> Column:
        made = [joined(F.lit(w), own), joined(F.lit(w.lower()), own)]
        shorter = [f for short in SHORT.get(w, []) for f in (joined(F.lit(short), own), joined(F.lit(short.lower()), own))]
        return F.when(own == "", F.array(*made)).otherwise(F.array(*made, *shorter))

    def within(w: str) -> Column:
        made = [joined(schedule, F.lit(w), own), joined(F.lower(schedule), F.lit(w.lower()), own)]
        for short in SHORT[w]:
            made += [joined(schedule, F.lit(short), own), joined(brief, F.lit(short), own), joined(F.lower(brief), F.lit(short.lower()), own)]
        return F.array(*made, schedule, F.lower(schedule), brief, F.lower(brief))

    named = F.when(name != "", name)
    variants = F.when(base == "act", F.array(F.coalesce(named, F.lit("Act")), F.lit("Act")))
    for w in ("Chapter", "Part", "Division", "Subdivision", "Section"):
        variants = variants.when(word == w, forms(w))
    for w in ("Part", "Division", "Subdivision", "Section"):
        variants = variants.when((word == "Schedule") & (inner == w), within(w))
    variants = variants.when(word == "Schedule", F.array(schedule, F.lower(schedule), brief, F.lower(brief)))
    given = F.when(_strip(F.coalesce(ref_id, F.lit(""))) != "", _strip(ref_id))
    # guides, operative provisions, definitions and unknown kinds go by their title
    plain = F.coalesce(named, F.nullif(own, F.lit("")), given, F.lit("Provision"))
    variants = F.array_distinct(F.array_compact(F.concat(variants.otherwise(F.array(plain)), F.array(given))))
    label = F.get(variants, F.lit(0))
    begins = F.substr(F.lower(name), F.lit(1), F.length(label)) == F.lower(label)
    heading = F.when(name == "", label).when(begins, name).otherwise(F.concat(label, F.lit(" — "), name))
    return F.struct(label.alias("label"), variants.alias("variants"), heading.alias("heading"))


def escaped(text: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def marker_indent(text: Column) -> Column:
    """The indentation class of a paragraph by its leading marker: numbers, then single letters, then
    Roman numerals or several letters (a single i, v or x is Roman); "" without one."""
    return (
        F.when(text.rlike(r"^\s*\(([ivx]+|[a-z]{2,})\)"), "pl-[4.5rem]")
        .when(text.rlike(r"^\s*\([a-z]\)"), "pl-12")
        .when(text.rlike(r"^\s*\([0-9]+[A-Z]?\)"), "pl-6")
        .otherwise("")
    )


#: The escapes of JSON that have a letter.
ESCAPES = {"0022": '\\"', "005c": "\\\\", "000a": "\\n", "000d": "\\r", "0009": "\\t", "0008": "\\b", "000c": "\\f"}


def json_string(text: Column) -> Column:
    """A JSON string of ASCII: UTF-16 units beyond the printable ones are escaped by their number, in lower case."""

    def shown(unit: Column) -> Column:
        out = F.when((unit >= "0020") & (unit <= "007e") & ~unit.isin("0022", "005c"), F.unhex(F.substr(unit, F.lit(3), F.lit(2))).cast("string"))
        for code, letter in ESCAPES.items():
            out = out.when(unit == code, letter)
        return out.otherwise(F.concat(F.lit("\\u"), unit))

    units = F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit("(.{4})"), F.lit(1))
    escaped = F.when(text.rlike(r"\A[ !#-\[\]-~]*\z"), text).otherwise(F.array_join(F.transform(units, shown), ""))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def canonical_json(fields: dict[str, Column | None], lists: dict[str, Column] | None = None) -> Column:
    """An object of strings (None: a null) and `lists` of strings with its keys in order, a blank after each comma and colon."""
    shown = {name: F.lit("null") if value is None else json_string(value) for name, value in fields.items()}
    for name, value in (lists or {}).items():
        shown[name] = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, json_string), ", "), F.lit("]")), F.lit("null"))
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), shown[name]) for name in sorted(shown))), F.lit("}"))


def json_etag(fields: dict[str, Column | None], lists: dict[str, Column] | None = None) -> Column:
    return F.sha2(canonical_json(fields, lists), 256)
