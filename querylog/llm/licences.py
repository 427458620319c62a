"""Licence scans with Spark expressions only: ordered signature rules.

Only texts with one of the gate words are looked at closely. Their words, lower-cased
and joined by single spaces, are what the rules' patterns run over; a rule runs only
where its keyword is present. Detections are intervals of that string. One that lies
inside another, or equals one that comes earlier, is suppressed; of two that overlap
the one of higher priority stays. The base phrases are looked up apart, word by word,
and their labels always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import PLAIN_WORD, ascii_lower, let

#: Phrases of the base, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword, and pattern of the name, on lower-cased words.
NAMES = (
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: (?:version |v)?3 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v)?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v? ?3(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[cs]e)? (?:version |v)?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version )?1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: (?:version )?2 0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version )?1 0)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: (?:version )?1 1)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:atives|s)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative", r"creative commons zero(?: (?:v ?)?1 0)?(?: universal)?"),
    ("cddl-1.0", "cddl", r"cddl(?: (?:version )?1 0)?"),
    ("cddl-1.0", "common", r"common development and distribution licen[cs]e(?: (?:version )?1 0)?"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: (?:version )?2 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v ?)?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v ?)?2 0)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: (?:version |v ?)?1 [12])?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: (?:version )?1 [123])?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v? ?2(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v? ?3(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v? ?[23](?: [01])?)?"),
    ("mit", "mit", r"(?:mit|mit x11|mit expat)"),
    ("mit-0", "mit", r"mit no attribution"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: (?:version |v ?)?2 0)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl-1.0", "database", r"open database licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 1)?"),
    ("openrail", "openrail", r"(?:creativeml )?open ?rail(?: ?[ms])?"),
    ("osl-3.0", "open", r"open software licen[cs]e(?: (?:version )?3 0)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf-2.0", "python", r"python software foundation"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: (?:version |v ?)?1)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("vim", "vim", r"vim"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
)
#: What may be said around a name, and the priority of saying it so.
PHRASES = (
    (r"spdx licen[cs]e identifier {}", 4),
    (r"(?:licen[cs]ed|distributed|released|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 3),
    (r"(?:under|by|to|of) the terms (?:and conditions )?of (?:the )?{}(?: licen[cs]e)?", 3),
    (r"(?:subject to|governed by|covered by) (?:the )?{}(?: licen[cs]e)?", 2),
    (r"(?:the )?{} licen[cs]e", 1),
)
#: Whole signatures that name no licence by its name.
SIGNATURES = (
    ("all-rights-reserved", "reserved", r"all rights reserved", 2),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 5),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 5),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu", 5),
    ("public-domain", "domain", r"(?:dedicated|released|placed) (?:in)?to the public domain", 4),
    ("public-domain", "domain", r"public domain", 1),
    ("proprietary", "proprietary", r"proprietary and confidential", 3),
    ("non-commercial", "commercial", r"for non ?commercial use only", 2),
)
#: Every rule's text has one of these.
_GATE = r"(?i)licen[cs]|spdx|rights reserved|permission|redistribut|public domain|proprietary|commercial|(?:distributed|released|available|published|provided) under|terms|subject to|governed by|covered by"


def rules() -> list[tuple[str, str, str, int]]:
    """Label, keyword, pattern and priority: every phrase with every name, full names, and the signatures."""
    named = [(label, key, phrase.format(f"(?:{name})"), rank) for label, key, name in NAMES for phrase, rank in PHRASES]
    named += [(label, key, name, 1) for label, key, name in NAMES if "licen" in name]
    return [(label, key, f"(?<= )(?:{pattern})(?= )", rank) for label, key, pattern, rank in [*named, *SIGNATURES]]


def _rule_table() -> Column:
    return F.array(
        *(
            F.struct(F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(pattern).alias("pattern"), F.lit(rank).alias("rank"))
            for label, key, pattern, rank in rules()
        )
    )


def _places(text: Column, rule: Column) -> Column:
    """Intervals of a rule's matches: lengths of what lies between and of the matches, summed up."""

    def sums(between: Column, found: Column) -> Column:
        def onward(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(between, i))
            stop = start + F.length(F.get(found, i))
            one = F.struct(start.alias("start"), (-stop).alias("back"), (-rule["rank"]).alias("low"), rule["label"].alias("label"))
            return F.struct(stop.alias("at"), F.concat(state["all"], F.array(one)).alias("all"))

        zero = F.struct(
            F.lit(0).alias("at"),
            F.expr("cast(array() as array<struct<start:int,back:int,low:int,label:string>>)").alias("all"),
        )
        places = F.filter(F.sequence(F.lit(0), F.size(found)), lambda i: i < F.size(found))
        return F.aggregate(places, zero, onward, lambda s: s["all"])

    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    return let(found, lambda f: let(F.split(text, rule["pattern"], F.lit(-1)), lambda between: sums(between, f)))


def _unsuppressed(detections: Column) -> Column:
    """Labels of the detections that remain.

    The strongest stand first: of equal priority the longer, then the earlier one, then
    by label. One is suppressed if it lies in, or overlaps, one that stands; a suppressed
    one suppresses nothing.
    """
    order = F.array_sort(F.transform(detections, lambda d: F.struct(
        d["low"].alias("low"), (d["start"] + d["back"]).alias("shorter"), d["start"].alias("start"), (-d["back"]).alias("stop"), d["label"].alias("label")
    )))

    def onward(kept: Column, one: Column) -> Column:
        meets = F.exists(kept, lambda k: (one["start"] < k["stop"]) & (k["start"] < one["stop"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(one)))

    zero = F.expr("cast(array() as array<struct<low:int,shorter:int,start:int,stop:int,label:string>>)")
    kept = F.aggregate(order, zero, onward)
    return F.transform(F.array_sort(F.transform(kept, lambda k: F.struct(k["start"], k["label"].alias("label")))), lambda k: k["label"])


def _base(words: Column) -> Column:
    """First words and labels of all base phrases, by position in the text."""

    def at(i: Column) -> Column:
        out = None
        for phrase, label in BASE:
            fits = F.lit(True)
            for k, word in enumerate(phrase.split()):
                fits = fits & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            out = F.when(fits, label) if out is None else out.when(fits, label)
        return F.struct(i.alias("at"), out.alias("label"))

    hit = F.transform(words, lambda w, i: F.when(w.isin(*{p.split()[0] for p, _ in BASE}), at(i)))
    return F.filter(hit, lambda h: h["label"].isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """Licence mentions of every document.

    Needs doc_id and text; other columns are ignored. Returns ``doc_id``, ``n_words``,
    ``n_base`` places of base phrases, ``first_word`` and ``last_word`` (their smallest
    and largest start, null without any), ``base_labels``, ``labels`` (those and the
    rules', distinct, sorted, comma-joined), ``score`` (0 without mention, towards 1
    with more) and ``detections`` (labels of all that is not suppressed). A null text
    is an empty one. Rows are independent of each other: repeated ones get the same, and
    there is no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = "|".join(sorted({key for _, key, _, _ in rules()}, key=lambda k: (-len(k), k)))
    words = F.transform(F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0)), ascii_lower)
    nothing = F.expr("named_struct('base', cast(array() as array<struct<at:int,label:string>>), 'found', cast(array() as array<string>))")

    def look(words: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

        def found(line: Column) -> Column:
            present = F.array_distinct(F.regexp_extract_all(line, F.lit(rf" ({keys})"), F.lit(1)))
            active = let(present, lambda p: F.filter(_rule_table(), lambda r: F.array_contains(p, r["key"])))
            return _unsuppressed(F.flatten(F.transform(active, lambda r: _places(line, r))))

        return F.struct(_base(words).alias("base"), let(joined, found).alias("found"))

    seen = F.when(text.rlike(_GATE), let(words, look)).otherwise(nothing)
    n_words = F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long")

    def results(s: Column) -> Column:
        places = F.transform(s["base"], lambda b: b["at"].cast("long"))
        base = F.array_sort(F.array_distinct(F.transform(s["base"], lambda b: b["label"])))
        both = F.array_sort(F.array_distinct(F.concat(base, s["found"])))
        n = F.size(s["base"]).cast("long")
        return F.struct(
            n.alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
            F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
            (1.0 - 1.0 / (1.0 + F.size(s["found"]) + n)).alias("score"), s["found"].alias("detections"),
        )

    return docs.select("doc_id", n_words.alias("n_words"), let(seen, results).alias("r")).select("doc_id", "n_words", "r.*")
