"""License scan with ordered signature rules.

A text becomes its lower-case words joined by single spaces. A rule is a regex
over that string with a label, a priority and the keywords a text must hold for
the rule to be tried. Rules come from ``FAMILIES`` x ``FORMS``, which look for a
licence's name, and from ``SIGNATURES``, sentences of the licence itself. What they
find is resolved by interval containment: a detection that lies inside one of
the same or a higher priority is dropped. Beside the rules, three base phrases
are counted word by word; their labels always stay.

Plan: one scan, no shuffle, DataFrame functions only. Substring tests gate the
work per document (every rule requires one of them), keywords gate it per rule,
so the regexes run on few texts. A rule's keywords are substrings of whatever
its regex matches, so gates change no result.

Defined cases: null and empty texts have no words, null first and last word,
empty labels and score 0; texts are scanned whole; other columns are ignored;
rows repeated under one doc_id are scanned each; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label (SPDX style), keyword that the text must hold, name as words, version as words ("" if none).
FAMILIES = [
    ("apache-1.1", "apache", "apache(?: software)?", "1 1"),
    ("apache-2.0", "apache", "apache(?: software)?", "2(?: 0)?"),
    ("mit", " mit ", "mit", ""),
    ("mit-0", " mit ", "mit no attribution", ""),
    ("x11", " x11 ", "x11", ""),
    ("isc", " isc ", "isc", ""),
    ("bsd-2-clause", " bsd ", "(?:simplified bsd|bsd 2 clause|2 clause bsd)", ""),
    ("bsd-3-clause", " bsd ", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)", ""),
    ("bsd-4-clause", " bsd ", "(?:original bsd|bsd 4 clause|4 clause bsd)", ""),
    ("0bsd", " bsd ", "zero clause bsd", ""),
    ("gpl-1.0", "general public", "(?:gnu )?general public", "1(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public", "2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public", "3(?: 0)?"),
    ("lgpl-2.0", "general public", "(?:gnu )?library general public", "2(?: 0)?"),
    ("lgpl-2.1", "general public", "(?:gnu )?lesser general public", "2 1"),
    ("lgpl-3.0", "general public", "(?:gnu )?lesser general public", "3(?: 0)?"),
    ("agpl-3.0", "general public", "(?:gnu )?affero general public", "3(?: 0)?"),
    ("gfdl-1.3", "free documentation", "(?:gnu )?free documentation", "1 3"),
    ("mpl-1.1", "mozilla", "mozilla public", "1 1"),
    ("mpl-2.0", "mozilla", "mozilla public", "2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public", "1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public", "2(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution", "1(?: 0)?"),
    ("cpl-1.0", "common public", "common public", "1(?: 0)?"),
    ("eupl-1.2", "european union", "european union public", "1 2"),
    ("osl-3.0", "open software", "open software", "3(?: 0)?"),
    ("afl-3.0", "academic free", "academic free", "3(?: 0)?"),
    ("artistic-1.0", "artistic", "artistic", "1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic", "2(?: 0)?"),
    ("bsl-1.0", "boost", "boost software", "1(?: 0)?"),
    ("zlib", " zlib ", "zlib", ""),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", " wtfpl ", "wtfpl", ""),
    ("ncsa", "illinois", "university of illinois ncsa open source", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("python-2.0", "python", "python software foundation", "2(?: 0)?"),
    ("php-3.01", " php ", "php", "3 01"),
    ("ruby", " ruby ", "ruby", ""),
    ("openssl", "openssl", "openssl", ""),
    ("ofl-1.1", "open font", "(?:sil )?open font", "1 1"),
    ("odbl-1.0", "open database", "open database", "1(?: 0)?"),
    ("cc0-1.0", " cc0 ", "(?:creative commons )?cc0", "1 0"),
    ("cc-by-3.0", " cc by ", "cc by", "3 0"),
    ("cc-by-4.0", " cc by ", "cc by", "4 0"),
    ("cc-by-sa-3.0", " cc by sa ", "cc by sa", "3 0"),
    ("cc-by-sa-4.0", " cc by sa ", "cc by sa", "4 0"),
    ("cc-by-nc-3.0", " cc by nc ", "cc by nc", "3 0"),
    ("cc-by-nc-4.0", " cc by nc ", "cc by nc", "4 0"),
    ("cc-by-nd-4.0", " cc by nd ", "cc by nd", "4 0"),
    ("cc-by-nc-sa-4.0", " cc by nc sa ", "cc by nc sa", "4 0"),
    ("cc-by-nc-nd-4.0", " cc by nc nd ", "cc by nc nd", "4 0"),
]
#: Form, keyword, priority, regex over the name N, the version V and the label's words W.
FORMS = [
    ("identifier", " spdx ", 100, "spdx licen[sc]e identifier {W}"),
    ("grant", " under ", 90, "(?:licensed|released|distributed|available|provided|published)(?: [^ ]+){0,3}? under(?: [^ ]+){0,4}? {N}(?: licen[sc]e)?(?:(?: version)? {V})"),
    ("title", " licen", 80, "{N} licen[sc]e(?:(?: version)? {V})"),
    ("link", " licenses ", 70, "licenses {W}"),
    ("version", "", 60, "{N}(?: version| v)? {V}"),
]
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software"
_MIT_FILES = f"{_MIT} and associated documentation files(?: the software)? to deal"
_ISC = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
_BSD = "redistribution and use in source and binary forms(?: with or without modification)? are permitted"
_FREE = "is free software you can redistribute it and or modify it under the terms of(?: version [^ ]+ of)? the gnu"
_FSF = "as published by the free software foundation(?: either)? version"
_GAP = "(?: [^ ]+){0,250}?"
#: Wordings of bodies and notices, without the licence's name: label, keyword, regex. Of two over the same words the longer one
#: holds, and of two as long the one that comes first.
SIGNATURES = [
    ("mit", "granted free of charge", _MIT),
    ("mit-0", "granted free of charge", f"{_MIT_FILES} in the software without restriction{_GAP} furnished to do so the software is provided"),
    ("x11", "granted free of charge", f"{_MIT}{_GAP} except as contained in this notice the name of"),
    ("ncsa", "granted free of charge", f"{_MIT_FILES} with the software"),
    ("bsl-1.0", "granted free of charge", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ofl-1.1", "granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("isc", "permission to use copy modify", f"{_ISC} provided that the above copyright notice"),
    ("0bsd", "permission to use copy modify", f"{_ISC} the software is provided"),
    ("postgresql", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd-2-clause", "redistribution and use in source", _BSD),
    ("apache-1.1", "redistribution and use in source", f"{_BSD}{_GAP} the end user documentation included with the redistribution{_GAP} must include the following acknowledge?ment"),
    ("openssl", "redistribution and use in source", f"{_BSD}{_GAP} the names openssl toolkit and openssl project must not be used"),
    ("bsd-4-clause", "redistribution and use in source", f"{_BSD}{_GAP} all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?:{_GAP} neither the name of)?"),
    ("bsd-3-clause", "redistribution and use in source", f"{_BSD}{_GAP} neither the name of"),
    ("gpl-1.0", "free software foundation", f"{_FREE} general public licen[sc]e {_FSF} 1"),
    ("gpl-2.0", "free software foundation", f"{_FREE} general public licen[sc]e {_FSF} 2"),
    ("gpl-3.0", "free software foundation", f"{_FREE} general public licen[sc]e {_FSF} 3"),
    ("lgpl-2.0", "free software foundation", f"{_FREE} library general public licen[sc]e {_FSF} 2"),
    ("lgpl-2.1", "free software foundation", f"{_FREE} lesser general public licen[sc]e {_FSF} 2 1"),
    ("lgpl-3.0", "free software foundation", f"{_FREE} lesser general public licen[sc]e {_FSF} 3"),
    ("agpl-3.0", "free software foundation", f"{_FREE} affero general public licen[sc]e {_FSF} 3"),
    ("gpl-2.0", "freedom to share and change", "the gnu general public licen[sc]e is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", "freedom to share and change", "the gnu general public licen[sc]e is intended to guarantee your freedom to share and change all versions"),
    ("apache-2.0", "each contributor hereby grants to you", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("mpl-2.0", "source code form is subject to", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("zlib", "permission is granted to anyone", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "changing it is allowed as long as", "changing it is allowed as long as the name is changed"),
    ("python-2.0", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e"),
    ("cc0-1.0", "associated a work with this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
]
SIGNATURE_PRIORITY = 90
GATE = (" all rights reserved ", " spdx ", " licenses ", *dict.fromkeys(x[1] for x in FAMILIES + SIGNATURES))
PRIORITIES = sorted({SIGNATURE_PRIORITY, *(p for _, _, p, _ in FORMS)})


def rules() -> list[dict]:
    """Every rule: id (position), label, keywords, regex, level (1: lowest priority), priority."""
    out = []
    for label, keyword, name, version in FAMILIES:
        words = label.replace("-", " ").replace(".", " ")
        for form, gate, priority, shape in FORMS:
            if form == "version" and not version:
                gate, shape = " licensed ", "(?:dual |multi )licensed {N}"
            shape = shape.replace("(?:(?: version)? {V})", "(?: version)? {V}" if version else "")
            body = shape.replace("{N}", name).replace("{V}", version).replace("{W}", words)
            keywords = [gate] if form in ("identifier", "link") else [keyword, gate] if gate else [keyword]
            out.append(
                {
                    "id": len(out), "label": label, "keywords": keywords, "regex": f"(?<= ){body}(?= )",
                    "level": PRIORITIES.index(priority) + 1, "priority": priority,
                }
            )
    level = PRIORITIES.index(SIGNATURE_PRIORITY) + 1
    for label, keyword, body in SIGNATURES:
        out.append({"id": len(out), "label": label, "keywords": [keyword], "regex": f"(?<= ){body}(?= )", "level": level, "priority": SIGNATURE_PRIORITY})
    return out


RULE_TYPE = "array<struct<id:int,label:string,keywords:array<string>,regex:string,level:int,priority:int>>"

_SPANS = """
flatten(transform(filter(transform(filter(_rules, r -> forall(r.keywords, k -> contains(_text, k))),
    r -> named_struct('r', r, 'gaps', split(_text, r.regex, -1), 'hits', regexp_extract_all(_text, r.regex, 0))),
    m -> size(m.hits) > 0),
  m -> aggregate(sequence(0, size(m.hits) - 1),
    named_struct('at', 0, 'out', cast(array() as array<struct<s:int,ne:int,np:int,id:int,level:int,label:string>>)),
    (a, i) -> named_struct(
      'at', a.at + length(m.gaps[i]) + length(m.hits[i]),
      'out', concat(a.out, array(named_struct(
         's', a.at + length(m.gaps[i]), 'ne', -(a.at + length(m.gaps[i]) + length(m.hits[i])),
         'np', -m.r.priority, 'id', m.r.id, 'level', m.r.level, 'label', m.r.label)))),
    a -> a.out)))
"""
#: Spans come by start, longest first, then priority: whatever contains a span stands before it.
_KEPT = f"""
aggregate(array_sort(_spans),
  named_struct('ends', array_repeat(0, {len(PRIORITIES)}),
               'out', cast(array() as array<struct<s:int,ne:int,np:int,id:int,level:int,label:string>>)),
  (a, d) -> if(array_max(slice(a.ends, d.level, {len(PRIORITIES)})) >= -d.ne, a, named_struct(
    'ends', transform(a.ends, (e, j) -> if(j + 1 = d.level, greatest(e, -d.ne), e)),
    'out', concat(a.out, array(d)))),
  a -> a.out)
"""


def _places(words: Column, phrase: str) -> Column:
    """Starts (words from 0) at which the phrase's words stand one after another."""

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + j) == w for j, w in enumerate(phrase.split())])

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections``: label, rule, priority, start and end in the normalised text.
    """
    # Beyond A-Z, lower() changes no text into or out of a phrase: only the Kelvin sign maps to an ASCII letter (k)
    # without a mark behind it, no base phrase has a k, and it is part of a word before and after.
    joined = F.trim(F.regexp_replace(F.lower(text_or_empty()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    d = docs.select("doc_id", joined.alias("_joined"))
    d = d.select("doc_id", F.concat(F.lit(" "), "_joined", F.lit(" ")).alias("_text"), (F.col("_joined") == "").alias("_none"))
    spaces = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(" "), F.lit("")))
    n_words = F.when(F.col("_none"), F.lit(0)).otherwise(spaces - 1).cast("long")
    gated = reduce(lambda a, b: a | b, [F.contains(F.col("_text"), F.lit(g)) for g in GATE])
    d = d.select("doc_id", n_words.alias("n_words"), F.when(gated, F.col("_text")).alias("_text"))
    d = d.withColumn("_words", F.when(F.col("_text").isNotNull(), F.split(F.trim("_text"), " ")))
    none = F.array().cast("array<int>")
    for k, phrase in enumerate(BASE):
        d = d.withColumn(f"_p{k}", F.when(F.contains(F.col("_text"), F.lit(f" {phrase} ")), _places(F.col("_words"), phrase)).otherwise(none))
    everywhere = F.concat(*[F.col(f"_p{k}") for k in range(len(BASE))])
    base = F.array_sort(F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(x)) for k, x in enumerate(BASE.values())]), lambda x: x.isNotNull()))
    d = d.withColumn("_places", everywhere).withColumn("_base", base)
    d = d.withColumn("_rules", F.from_json(F.lit(json.dumps(rules())), RULE_TYPE))
    d = d.withColumn("_spans", F.when(F.col("_text").isNotNull(), F.expr(_SPANS)))
    d = d.withColumn("_kept", F.when(F.size("_spans") > 0, F.expr(_KEPT)))
    found = F.coalesce(F.transform("_kept", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(-F.array_min(F.transform("_kept", lambda x: x["np"])), F.lit(0))
    return d.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", found))), ",").alias("labels"),
        (F.greatest(best, F.when(F.size("_places") > 0, 40).otherwise(0)) / F.lit(100.0)).alias("score"),
        F.transform("_kept", lambda x: F.struct(x["label"].alias("label"), x["id"].alias("rule"), (-x["np"]).alias("priority"), x["s"].alias("start"), (-x["ne"]).alias("end"))).alias("detections"),
    )
