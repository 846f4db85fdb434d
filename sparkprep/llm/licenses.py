"""Licence recognition by sentence rules.

A text loses its comment marks at line starts and is cut into sentences: at
sentence ends, blank lines, list items, after copyright lines and before lines
that open a known sentence; any other line end is a soft wrap. Sentences are
normalised (lower case, one space for what is not a letter, digit or ``. + -``,
one spelling of "license", no trailing ``.0``) and mapped to the identifier of
the first known licence sentence they match; one that matches none is
``unknown`` if it has a trigger word, else left out. Lines of a wrapped sentence
are read one by one: a line known by itself, or one that makes what is known so
far unknown, opens another sentence; sentences may be of any length. The identifiers of a text, in order and
without the unknown ones, are then matched against the licence rules in their
order: a rule names a run of identifiers, and what it matches is used up. For
texts with each sentence on one line and no unknown one inside a rule's run, this
is the scan that the registered SQL states.

Defined results: a null text or one without a trigger has no identifiers and no
licences; equal rows get equal results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

TRIGGER = "licen[cs]|copyright|redistribut|warrant|hereby granted|public domain|all rights reserved|free software"

# Names of licences as sentences write them (normalised), by identifier.
NAMED = {
    "AGPL-3.0": "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?-?3",
    "LGPL-3.0": "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?-?3",
    "LGPL-2.1": "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?-?2.1",
    "GPL-3.0": "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?-?3",
    "GPL-2.0": "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?-?2",
    "Apache-2.0": "apache(?: software)?(?: license)?(?: version| v)? ?-?2",
    "MPL-2.0": "(?:mozilla public license|mpl)(?: version| v)? ?-?2",
    "EPL-2.0": "(?:eclipse public license|epl)(?: version| v)? ?-?2",
    "BSD-3-Clause": "(?:3-clause bsd|bsd 3-clause|bsd-3-clause|new bsd|modified bsd)(?: license)?",
    "BSD-2-Clause": "(?:2-clause bsd|bsd 2-clause|bsd-2-clause|simplified bsd)(?: license)?",
    "MIT": "mit(?: license)?",
    "ISC": "isc(?: license)?",
    "CC-BY-NC-ND": "(?:cc|creative commons) (?:by-nc-nd|attribution-noncommercial-noderivatives)(?: [1-4][.0-9]*)?(?: international)?(?: license)?",
    "CC-BY-NC-SA": "(?:cc|creative commons) (?:by-nc-sa|attribution-noncommercial-sharealike)(?: [1-4][.0-9]*)?(?: international)?(?: license)?",
    "CC-BY-NC": "(?:cc|creative commons) (?:by-nc|attribution-noncommercial)(?: [1-4][.0-9]*)?(?: international)?(?: license)?",
    "CC-BY-ND": "(?:cc|creative commons) (?:by-nd|attribution-noderivatives)(?: [1-4][.0-9]*)?(?: international)?(?: license)?",
    "CC-BY-SA": "(?:cc|creative commons) (?:by-sa|attribution-sharealike)(?: [1-4][.0-9]*)?(?: international)?(?: license)?",
    "CC-BY": "(?:cc|creative commons) (?:by|attribution)(?: [1-4][.0-9]*)?(?: international)?(?: license)?",
    "CC0-1.0": "(?:cc0|creative commons zero)(?: 1)?(?: universal)?(?: license)?",
    "Unlicense": "(?:the )?unlicense",
}

# The GNU licences: name in sentences, version (normalised).
GNU = {"AGPL-3.0": ("affero general public license", "3"), "LGPL-3.0": ("lesser general public license", "3"),
       "LGPL-2.1": ("lesser general public license", "2.1"), "LGPL-2.0": ("(?:library|lesser) general public license", "2"),
       "GPL-3.0": ("general public license", "3"), "GPL-2.0": ("general public license", "2"), "GPL-1.0": ("general public license", "1")}
FAMILIES = {"AGPL": "affero general public license", "LGPL": "(?:library|lesser) general public license", "GPL": "general public license"}

# Normalised sentences of licence texts, by identifier.
SENTENCES = {
    "copyright": "copyright (?:c )?[12][0-9]{3}.*|copyright c .*|(?:.* )?all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind.*",
    "isc-grant": "permission to use copy modify and/?or distribute this software for any purpose with or without fee is hereby granted.*",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties.*",
    "apache-grant": "licensed under the apache license version 2 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at.*",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    **{f"gnu:{k}": f"(?:this (?:program|library) is free software )?you can redistribute it and/or modify it under the terms of the gnu {p} .*version {v}(?: .*)?"
       for k, (p, v) in GNU.items()},
    **{f"gnu-terms:{k}": f"(?:this (?:program|library) is free software )?you can redistribute it and/or modify it under the terms of the gnu {p}"
                         "(?: as published by the free software foundation)?" for k, p in FAMILIES.items()},
    **{f"gnu-version:{v}": f"(?:either )?version {v} of the license(?: .*)?" for v in ("1", "2", "2.1", "3")},
    **{f"gnu-title:{k}": f"gnu {p}(?: version)? {v} (?:[0-9]+ )?(?:june|november|february) [12][0-9]{{3}}.*" for k, (p, v) in GNU.items()},
    "apache-title": "apache license version 2 january 2004.*",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v.*",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications.*",
    "negated": "(?:.* )?(?:not|never|no longer|neither|isn t|aren t) (?:.* )?(?:licensed|released|distributed|available|published|provided) under .*",
    "gpl-free": "this (?:program|library) is free software.*",
    "gpl-hope": "this (?:program|library) is distributed in the hope that it will be useful.*",
    "gpl-see": "see the gnu (?:lesser |affero )?general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu (?:lesser |affero )?general public license.*",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted.*",
    "bsd-source": ".*redistributions of source code must retain the above copyright notice.*",
    "bsd-binary": ".*redistributions in binary form must reproduce the above copyright notice.*",
    "bsd-names": ".*neither the name of .* may be used to endorse or promote products.*",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is.*",
    "public-domain": ".*(?:released|dedicated|is|placed) (?:in|into|to) the public domain.*",
}
_VERBS = "(?:.* )?(?:is |are )?(?:(?:dual-|dual |multi-)?licensed|released|distributed|available|published|provided) under (?:either )?(?:the |an? )?(?:terms of the )?(?:terms and conditions of the )?"
_OPTION = "(?: license)?(?: or (?:at your option )?any later version)?"
KNOWN: list[tuple[str, str]] = [
    *((k, f"^(?:{p})$") for k, p in SENTENCES.items()),
    *((f"spdx:{k}", f"^spdx-license-identifier (?:{k.lower().replace('.0', '')}|{k.lower()})(?:-only|-or-later)?$") for k in NAMED),
    *((f"ref:{k}", f"^{_VERBS}(?:{p}){_OPTION}$") for k, p in NAMED.items()),
]

# Licence rules, in order: name and run of sentence identifiers.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-comply")),
    ("Apache-2.0", ("apache-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    *((k, (f"gnu:{k}",)) for k in GNU),
    *((k, (f"gnu-terms:{k.split('-')[0]}", f"gnu-version:{v}")) for k, (_, v) in GNU.items()),
    *((k, (f"gnu-terms:{k}",)) for k in FAMILIES),
    *((k, (f"gnu-title:{k}",)) for k in GNU),
    ("Apache-2.0", ("apache-title",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("zlib", ("zlib-grant",)),
    ("GPL", ("gpl-free", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL", ("gpl-free", "gpl-hope")),
    ("MIT", ("mit-grant",)),
    ("public-domain", ("public-domain",)),
    *((k, (f"spdx:{k}",)) for k in NAMED),
    *((k, (f"ref:{k}",)) for k in NAMED),
]
SENTENCE_END = "\\n|[.!?;][ \\t\\r\\x0B\\f]+"

# Words of known sentences that may hold no trigger word.
ALSO = "in the hope that it will be|endorse or promote"
# How a line begins that opens a known sentence, and a copyright line.
OPENERS = (
    "copyright (?:\\(c\\)|\u00a9|[12][0-9]{3})|all rights reserved|spdx-license|permission (?:is hereby granted|to use)|the above copyright notice and|"
    "the software is provided|(?:dual-?)?licensed under|released under|you may (?:not use this|obtain a copy)|unless required by applicable|"
    "see the license for|this (?:program|library) is (?:free|distributed)|you should have received|redistributions? (?:and use )?(?:of|in) |"
    "redistribution and use|neither the name|this software is provided")
COPYRIGHT_LINE = "(?m)^([ \\t]*(?:copyright (?:\\(c\\)|\u00a9|[12][0-9]{3})|\u00a9).*)$"
COMMENT_MARK = "(?m)^[ \\t]*(?:(?:[/#*;%!>|\"']|--|<!--|\\(\\*)+|(?:rem|dnl|[.]{2})(?=[ \\t]|$))[ \\t]*"
LIST_ITEM = "(?!\\(c\\) ?[12][0-9])(?:[-+\u2022]|\\(?(?:[0-9]{1,2}|[a-z])[.)])[ \\t]+"
HARD_END = (f"\\n[ \\t\\x0B\\f]*\\n\\s*|[.!?;:][\"')\\]]*[ \\t]*\\n|[.!?;][ \\t\\x0B\\f]+"
            f"|\\n[ \\t]*{LIST_ITEM}|\\n(?=[ \\t]*(?:{OPENERS}))")
# more characters than any known sentence fixes: a longer one is known by its open ends
FIXED = 800
# Licence expressions (lower case) that are rewritten, each licence as a sentence of its own; two rounds part three.
_LICENCE = "mit|apache|bsd|gnu|gpl|lgpl|agpl|mpl|mozilla|isc|epl|eclipse|cc|cc0|creative commons|unlicense"
EXPRESSIONS = [
    ("(spdx-license-identifier:?[ ]+)[(]([^()\n]*)[)]", "\\1\\2"),
    *[("(spdx-license-identifier:?[ ]+[^ \n]+) with [^ \n]+", "\\1"),
      ("(spdx-license-identifier:?[ ]+[^ \n]+) (?:or|and) [(]?([^ \n)]+)[)]?", "\\1\nspdx-license-identifier: \\2")] * 3,
    *[(f"(licensed under [^\n.;]*?[^\n.; ]),? (?:and/or|and|or) (?:under )?((?:either |the |an? )?(?:{_LICENCE})[ -])", "\\1\nlicensed under \\2")] * 2,
]
# identifiers whose sentences may go on in any way
OPEN_ENDED = [k for k, p in SENTENCES.items() if p.endswith(".*") or p.endswith("(?: .*)?")]


def rule_pattern(ids: tuple[str, ...]) -> str:
    """A run of identifiers in a sequence written ``,a,,b,,c,``."""
    return "".join(f",{i.replace('.', '[.]')}," for i in ids)


def normalised(sentence: Column) -> Column:
    """The form in which sentences are compared."""
    s = F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.+/-]+", " "), F.lit(" .-/"))
    s = F.regexp_replace(s, "licence", "license")
    s = F.regexp_replace(s, "([0-9])[.]0([^0-9.]|$)", "$1$2")
    return F.regexp_replace(s, " [./-]+ ", " ")


def parted(low: Column) -> Column:
    """A lower-cased text with the licences of an expression as sentences of their own."""
    out = low
    for pattern, by in EXPRESSIONS:
        out = F.regexp_replace(out, pattern, by.replace("\\1", "$1").replace("\\2", "$2"))
    return F.when(F.rlike(low, F.lit("spdx-license|licensed under")), out).otherwise(low)


def sentences_of(low: Column) -> Column:
    """Sentences of a lower-cased text; soft wraps stay as line ends."""
    plain = F.regexp_replace(F.regexp_replace(low, "\\r\\n?", "\n"), COMMENT_MARK, "")
    return F.split(F.regexp_replace(plain, COPYRIGHT_LINE, "$1\n"), HARD_END)


def scanned(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, licenses, sentence_ids (arrays in order) and n_unknown of every row."""
    known = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("pattern")) for i, p in KNOWN))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(rule_pattern(ids)).alias("pattern")) for n, ids in RULES))
    low = parted(F.lower(F.coalesce(F.col(text), F.lit(""))))
    trigger = f"{TRIGGER}|spdx-license"
    none = F.array().cast("array<string>")

    def known_of(n: Column) -> Column:
        return F.get(F.filter(known, lambda k: F.rlike(n, k["pattern"])), F.lit(0))["id"]

    def known_id(s: Column) -> Column:
        return let(normalised(s), known_of)

    def identified(s: Column) -> Column:
        """Identifiers of one sentence that may be wrapped. The state while its lines are read: ``cur``, the open
        sentence as far as it matters, ``id``, what it is known as, ``hit``, a trigger was seen, ``first`` and ``n``,
        its lines, and ``long``: beyond FIXED characters only sentences open at their beginning can become known (of
        these the end of the sentence tells, behind a word that keeps others from matching), and what is known and open-ended
        stays so; sentences open in several places are looked at whole when they end."""
        lines = F.split(s, "\n")

        def closed(run: Column) -> Column:
            whole = F.when(run["long"] & run["id"].isNull(), known_id(F.array_join(F.slice(lines, run["first"] + 1, run["n"]), "\n")))
            last = F.coalesce(run["id"], whole, F.when(run["hit"], F.lit("unknown")))
            return let(last, lambda i: F.when(i.isNull(), run["ids"]).otherwise(F.concat(run["ids"], F.array(i))))

        def state(ids: Column, cur: Column, id_: Column, hit: Column, first: Column, n: Column, long: Column) -> Column:
            return F.struct(ids.alias("ids"), cur.alias("cur"), id_.alias("id"), hit.alias("hit"), first.alias("first"), n.alias("n"), long.alias("long"))

        def step(run: Column, line: Column) -> Column:
            joined = F.concat_ws("\n", run["cur"], line)

            def of(now: Column) -> Column:
                hit = F.rlike(line, F.lit(trigger))
                opens = now["alone"].isNotNull() | now["joined"].isNull() & run["id"].isNotNull()
                begun = state(closed(run), line, now["alone"], hit, run["first"] + run["n"], F.lit(1), F.length(line) > 4 * FIXED)
                cur = F.when(run["long"], F.right(joined, F.lit(4 * FIXED))).otherwise(joined)
                gone_on = state(run["ids"], cur, now["joined"], run["hit"] | hit, run["first"], run["n"] + 1, run["long"] | (now["size"] > FIXED))
                return F.when(opens, begun).otherwise(gone_on)

            sticky = run["long"] & run["id"].isin(OPEN_ENDED)
            later = F.when(sticky, run["id"]).otherwise(let(F.concat(F.lit("x "), normalised(F.right(joined, F.lit(4 * FIXED)))), known_of))
            first = let(normalised(joined), lambda n: F.struct(known_of(n).alias("id"), F.length(n).alias("size")))
            found = F.when(run["long"], F.struct(later.alias("id"), F.lit(0).alias("size"))).otherwise(first)
            return let(found, lambda f: let(F.struct(known_id(line).alias("alone"), f["id"].alias("joined"), f["size"].alias("size")), of))

        start = state(none, F.lit(""), F.lit(None).cast("string"), F.lit(False), F.lit(0), F.lit(0), F.lit(False))
        one = let(F.coalesce(known_id(s), F.when(s.rlike(trigger), F.lit("unknown"))), lambda i: F.when(i.isNull(), none).otherwise(F.array(i)))
        return F.when(F.instr(s, "\n") > 0, F.aggregate(lines, start, step, closed)).otherwise(one)

    near = F.filter(sentences_of(low), lambda s: F.rlike(F.regexp_replace(s, "\\s+", " "), F.lit(f"{trigger}|{ALSO}")))
    ids = F.when(F.rlike(F.regexp_replace(low, "[\\s/#*;%!>|\"']+", " "), F.lit(trigger)), F.flatten(F.transform(near, identified))).otherwise(none)
    rows = df.select(F.col(id_col), ids.alias("__ids"))
    sequence = F.array_join(F.transform(F.filter("__ids", lambda i: i != "unknown"), lambda i: F.concat(F.lit(","), i, F.lit(","))), "")
    start = F.struct(sequence.alias("left"), none.alias("found"))
    found = F.aggregate(rules, start, lambda a, r: F.struct(
        F.regexp_replace(a["left"], r["pattern"], F.lit(",#,")).alias("left"),
        F.when(F.rlike(a["left"], r["pattern"]), F.concat(a["found"], F.array(r["name"]))).otherwise(a["found"]).alias("found")),
        lambda a: F.array_distinct(a["found"]))
    return rows.select(id_col, F.when(F.size("__ids") > 0, found).otherwise(none).alias("licenses"),
                       F.col("__ids").alias("sentence_ids"), F.size(F.filter("__ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"))
