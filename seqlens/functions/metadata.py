"""Column functions over annotated records: qualifiers, hosts, countries, years, technologies, labels.

A record has: ord, accession, name, description, organism, seq, comment, structured_comment (map of maps), features
(array of struct<type, qualifiers: map<string, array<string>>>), reference_titles. All functions are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlens.functions import fixed

UNKNOWN = "Unknown"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and named in the plan, which keeps plans of nested expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(patterns: list[str]) -> str:
    """One case-insensitive, Unicode-aware pattern for several."""
    return "(?iu)(?:" + "|".join(patterns) + ")"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def first_source(features: Column) -> Column:
    """The first source feature; null if there is none."""
    return F.get(F.filter(features, lambda f: f["type"] == "source"), F.lit(0))


def qualifier(feature: Column, key: str) -> Column:
    """The first value of a qualifier; null if it is missing."""
    return F.get(F.try_element_at(feature["qualifiers"], F.lit(key)), F.lit(0))


def values(features: Column, types: list[str], keys: list[str]) -> Column:
    """All values of these qualifiers of all features of these types, in order."""
    chosen = F.filter(features, lambda f: f["type"].isin(types))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(chosen, lambda f: F.concat(*[F.coalesce(F.try_element_at(f["qualifiers"], F.lit(k)), none) for k in keys])))


def filled(c: Column) -> Column:
    """Stripped, null if empty."""
    return F.nullif(strip(c), F.lit(""))


# technology


def technology_text(r: dict[str, Column]) -> Column:
    """What a record says that may tell of its sequencing, in lower case."""
    blocks = F.map_values(r["structured_comment"])
    told = F.flatten(F.transform(blocks, lambda b: F.map_values(F.map_filter(b, lambda k, _: reduce(Column.__or__, [F.contains(F.lower(k), F.lit(x)) for x in fixed.STRUCTURED_KEYS])))))
    noted = values(r["features"], ["source", "misc_feature", "gene"], ["note", "db_xref", "mol_type", "isolation_source", "PCR_primers"])
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(told, none), F.array(F.nullif(r["comment"], F.lit(""))), F.coalesce(noted, none), F.array(F.nullif(r["description"], F.lit("")), F.nullif(r["name"], F.lit(""))))
    return F.lower(F.concat_ws(" ", parts))


def technology(text: Column) -> Column:
    """The first technology whose patterns a text shows."""
    return let(text, lambda t: F.coalesce(*[F.when(t.rlike(any_of(p)), F.lit(name)) for name, p in fixed.TECHNOLOGIES], F.lit(UNKNOWN)))


# hosts


def generic_hosts(genus: str) -> list[str]:
    return [*fixed.GENERIC_HOSTS, f"{genus.lower()} sp.", f"{genus.lower()} hominis"]


def normalise_host(c: Column, genus: str) -> Column:
    """A host's standard name: generic ones are Unknown, others that have none stay as they are, stripped."""
    return let(strip(c), lambda h: F.when(h.isNull() | F.lower(h).isin(generic_hosts(genus)), F.lit(UNKNOWN)).otherwise(F.coalesce(F.try_element_at(literal_map(fixed.HOSTS), F.lower(h)), h)))


def title(c: Column) -> Column:
    """Each run of letters with its first letter in upper case and the others in lower case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), "")


def coalesce_host(features: Column, organism: Column, genus: str) -> Column:
    """struct<host, host_source>: from the host qualifier, else from an isolation source that names an animal and no
    sample, else from the notes, else from the species, else Unknown."""
    told = let(first_source(features), lambda f: F.struct(filled(qualifier(f, "host")).alias("host"), filled(qualifier(f, "isolation_source")).alias("isolation"), F.concat_ws(" ", F.try_element_at(f["qualifiers"], F.lit("note"))).alias("note")))
    facts = F.struct(told.alias("told"), F.lower(strip(organism)).alias("organism"))
    return let(facts, lambda x: _host(x["told"]["host"], x["told"]["isolation"], F.coalesce(x["told"]["note"], F.lit("")), x["organism"], genus))


def _host(host: Column, isolation: Column, note: Column, organism: Column, genus: str) -> Column:
    generic = generic_hosts(genus)
    low = F.lower(isolation)
    animal = low.isin(list(fixed.HOSTS)) | low.rlike(r"(?u)\b(?:" + "|".join(fixed.ANIMAL_WORDS) + r")\b") | low.rlike(r"^[a-z]+\s+[a-z]+$")
    sample = low.rlike(r"(?u)\b(?:" + "|".join(fixed.SAMPLE_WORDS) + r")\b")
    found = lambda v, s: F.struct(v.alias("host"), F.lit(s).alias("host_source"))
    captured = strip(F.regexp_extract(note, "(?iu)" + fixed.NOTE_HOSTS[0], 1))
    from_note = [F.when(note.rlike("(?iu)" + fixed.NOTE_HOSTS[0]), let(captured, lambda c: F.when(~F.lower(c).isin(generic), title(c))))]
    from_note += [F.when(note.rlike("(?iu)" + p), F.lit("Human")) for p in fixed.NOTE_HOSTS[1:]]
    species = F.coalesce(*[F.when(F.contains(organism, F.lit(f"{genus.lower()} {s}")), F.lit(h)) for s, h in fixed.SPECIES_HOSTS.items()])
    other = let(F.struct(F.coalesce(*from_note).alias("n"), species.alias("s")), lambda x: F.when(x["n"].isNotNull(), found(x["n"], "note")).when(x["s"].isNotNull(), found(x["s"], "organism")).otherwise(found(F.lit(UNKNOWN), "unknown")))
    return F.when(~F.lower(host).isin(generic), found(host, "host_qualifier")).when(~low.isin(generic) & animal & ~sample, found(isolation, "isolation_source")).otherwise(other)


# places and dates


def country(geo: Column, old: Column) -> Column:
    """The present qualifier's value, else the former one's."""
    return F.coalesce(filled(geo), filled(old), F.lit(UNKNOWN))


def normalise_country(c: Column) -> Column:
    """What stands before the first colon, then before the first comma."""
    head = strip(F.substring_index(strip(F.substring_index(c, ":", 1)), ",", 1))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit(UNKNOWN))


def year(c: Column) -> Column:
    """The latest year from 1900 to 2099 that a date names."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(19[0-9]{2}|20[0-9]{2})"), F.lit(1)), lambda y: y.cast("int")))


# labels


def declared_labels(features: Column, name: Column, description: Column, genus: str) -> Column:
    """The distinct labels that the source features, the name and the head of the description declare, sorted as strings."""
    told = values(features, ["source"], ["isolate", "clone", "strain", "note", "specific_host"])
    text = F.concat_ws(" ", F.concat(F.coalesce(told, F.array().cast("array<string>")), F.array(F.coalesce(name, F.lit("")), F.substring(F.coalesce(description, F.lit("")), 1, 120))))
    patterns = [r"(?iu)\bsubtype\s*(\d+)\b", r"(?u)\bST\s*(\d+)\b", rf"(?iu)\b(?:{genus}\s+sp\.?\s*)?ST(\d+)[-_]"]
    numbers = let(text, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns]))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("ST"), F.regexp_replace(n, r"^0+(?=\d)", "")))))


def label_of(declared: Column) -> Column:
    """struct<label, confidence>: a sole label is high; of several the first as a string is medium; none is null."""
    return let(declared, _label)


def _label(declared: Column) -> Column:
    return F.when(F.size(declared) == 1, F.struct(F.array_min(declared).alias("label"), F.lit("high").alias("confidence"))).when(F.size(declared) > 1, F.struct(F.array_min(declared).alias("label"), F.lit("medium").alias("confidence")))


def list_text(c: Column) -> Column:
    return F.when(F.size(c) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))


def validate_claim(declared: Column, claimed: Column) -> Column:
    """struct<keep, confidence, reason> of a record that was fetched for a label."""
    return let(declared, lambda d: _verdict(d, claimed))


def _verdict(declared: Column, claimed: Column) -> Column:
    verdict = lambda k, c, r: F.struct(F.lit(k).alias("keep"), F.lit(c).alias("confidence"), r.alias("reason"))
    return (
        F.when(claimed.startswith("NMAST"), verdict(True, "low", F.lit("NMAST — query trusted")))
        .when(F.size(declared) == 0, verdict(True, "low", F.lit("no ST declared in source feature; query trusted")))
        .when(F.array_contains(declared, claimed) & (F.size(declared) == 1), verdict(True, "high", F.concat(F.lit("source declares "), claimed, F.lit(" only"))))
        .when(F.array_contains(declared, claimed), verdict(True, "medium", F.concat(F.lit("source declares "), claimed, F.lit(" alongside "), list_text(F.array_remove(declared, claimed)))))
        .otherwise(verdict(False, "rejected", F.concat(F.lit("source declares "), list_text(declared), F.lit(", not "), claimed)))
    )


def tag(description: Column, key: str) -> Column:
    """The value of the first [key=value] in a header."""
    pattern = rf"\[{key}=([^\]]+)\]"
    return F.when(description.rlike(pattern), strip(F.regexp_extract(description, pattern, 1))).otherwise(F.lit(UNKNOWN))


TAGS = ("subtype", "host", "country", "date", "isolation_source", "seq_tech", "confidence", "host_source")


def header(description: Column, tags: dict[str, Column]) -> Column:
    """A header with its tags, in the order of TAGS."""
    return F.concat_ws(" ", F.coalesce(description, F.lit("")), *[F.concat(F.lit(f"[{t}="), F.coalesce(tags[t], F.lit(UNKNOWN)), F.lit("]")) for t in TAGS])


def number_in(label: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(label, r"\d+", 0), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def natural_order(label: Column) -> list[Column]:
    """Sort keys: ST, then NMAST, novel, unassigned, all others; by number, then by text."""
    group = F.when(label.startswith("NMAST"), 1).when(label.startswith("novel"), 2).when(label == "ST_unassigned", 8).when(label.startswith("ST"), 0).otherwise(9)
    number = F.when(F.coalesce(group, F.lit(9)).isin(0, 1, 2), number_in(label)).otherwise(F.lit(0).cast("bigint"))
    return [F.coalesce(group, F.lit(9)), number, F.coalesce(label, F.lit(""))]


def label_group(label: Column) -> Column:
    """The group that time series are stacked by."""
    return (
        F.when(label.startswith("novel_"), "novel candidates")
        .when(label == "ST_unassigned", "ST_unassigned")
        .when(label.isin("ST1", "ST2", "ST3"), "ST1-ST3 (dominant human)")
        .when(label.isin("ST4", "ST5", "ST6", "ST7", "ST8", "ST9"), "ST4-ST9 (frequent)")
        .otherwise("other STs")
    )


def is_known_label(label: Column) -> Column:
    return ~label.startswith("novel_") & (label != "ST_unassigned") & (label.startswith("ST") | label.startswith("NMAST"))


def bare_accession(c: Column) -> Column:
    """Without the version."""
    return F.substring_index(c, ".", 1)


# filters


def is_predicted(accession: Column) -> Column:
    return F.substring(accession, 1, 3).isin(fixed.PREDICTED_PREFIXES)


def bad_molecule(features: Column) -> Column:
    """The molecule type of a record that can't be a gene's, else null."""
    kind = F.lower(F.coalesce(strip(qualifier(first_source(features), "mol_type")), F.lit("")))
    return let(kind, lambda k: F.when(~k.isin(fixed.MOLECULE_TYPES) & (F.contains(k, F.lit("protein")) | (k == "mrna")), k))


def drop_reason(accession: Column, features: Column) -> Column:
    return F.when(is_predicted(accession), F.lit("predicted")).when(bad_molecule(features).isNotNull(), F.lit("molecule_type"))


def length_class(n: Column, short_min: int = fixed.SHORT_MIN, short_max: int = fixed.SHORT_MAX, full_max: int = fixed.MAX_LENGTH) -> Column:
    return F.when(n < short_min, "too_short").when(n <= short_max, "short").when(n <= full_max, "full_length").otherwise("too_long")


# texts


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside brackets."""
    return re.findall(r"(?:[^|()]|\([^()]*\))+", pattern)


def sure_word(pattern: str) -> str:
    """The longest run of letters, in lower case, that each match of a pattern without bars outside brackets holds: of what is left without escapes, brackets, and letters that
    may be missing."""
    plain = re.sub(r"\\[a-zA-Z][+*?]?|\([^()]*\)\??|\[[^\]]*\][+*?]?|\w[?*]", " ", pattern)
    return max(re.findall("[A-Za-z]+", plain), key=len).lower()


def folded(text: Column) -> Column:
    """In lower case, with the letters beyond ASCII that patterns take for ASCII letters as these (the Kelvin sign is lowered to k)."""
    return F.replace(F.replace(F.lower(F.replace(text, F.lit("\u0130"), F.lit("i"))), F.lit("\u0131"), F.lit("i")), F.lit("\u017f"), F.lit("s"))


#: A word that stands in whatever matches, for each alternative of the disease patterns.
DISEASE_WORDS = {a: sure_word(a) for p in fixed.DISEASES.values() for a in alternatives(p)}


def shows(text: Column, words: Column, pattern: str) -> Column:
    """Whether a text shows a disease pattern: an alternative is searched for only where its word is among those that the text holds."""
    return reduce(Column.__or__, [F.array_contains(words, DISEASE_WORDS[a]) & text.rlike(any_of([a])) for a in alternatives(pattern)])


def classify(text: Column, evidence: bool = True) -> Column:
    """array<struct<category, evidence>> of the disease contexts that a text shows, in order of report: evidence is the first match (null if not asked for).
    The weak context goes if there is any other, the general one if there is the special one.

    Plain words are looked for first, each once, as a pattern that ignores case takes longer at each place than all of them."""
    first = lambda p: F.regexp_extract(text, any_of([p]), 0) if evidence else F.lit(None).cast("string")
    words = let(folded(text), lambda low: F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in sorted(set(DISEASE_WORDS.values()))]), lambda w: w.isNotNull()))
    hits = let(words, lambda w: F.array(*[F.when(shows(text, w, p), F.struct(F.lit(c).alias("category"), first(p).alias("evidence"))) for c, p in fixed.DISEASES.items()]))
    return let(F.filter(hits, lambda h: h.isNotNull()), _by_rule)


def _by_rule(hits: Column) -> Column:
    has = lambda c: F.exists(hits, lambda h: h["category"] == c)
    weak_goes, general_goes = F.size(hits) > 1, has(fixed.SPECIAL_DISEASE)
    return F.filter(hits, lambda h: ~((h["category"] == fixed.WEAK_DISEASE) & weak_goes) & ~((h["category"] == fixed.GENERAL_DISEASE) & general_goes))


def categories(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: h["category"]), ";")


def evidence(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat(h["category"], F.lit("="), h["evidence"])), ";")


def joined_text(*columns: Column) -> Column:
    """Those that are not null, with a bar between."""
    return F.concat_ws(" | ", *columns)


def content_hash(seq: Column) -> Column:
    return F.md5(F.upper(seq))


def palette(n: int) -> list[str]:
    """n colours around the wheel, of alternating saturation and brightness."""
    import colorsys

    made = [colorsys.hsv_to_rgb(i / n, (0.75, 0.55)[i % 2], (0.85, 0.65)[i // 2 % 2]) for i in range(n)]
    return ["#" + "".join(f"{int(255 * x):02X}" for x in rgb) for rgb in made]


def hover(fields: list[tuple[str, Column]]) -> Column:
    """Lines "name: value" joined by HTML breaks."""
    return F.concat_ws("<br>", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(UNKNOWN))) for k, v in fields])
