"""License scans by sentence rules (operator 5).

Native: SQL functions only. A text is cut into sentences, each sentence is
normalised (lower case, letters, digits and dots inside versions only) and
looked up in a small table of known licence sentences. What is left of a
text is a sequence of sentence identifiers; ordered licence rules are
matched against it. A rule names the identifiers that must follow one
another, with at most ``gap`` other sentences in between.

Published notices are longer than one sentence form and hard-wrapped: they
are found as phrases of the normalised words from a line on, over the line
ends that follow, and count at the sentence where they begin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distillery.llm.shared import col


@dataclass(frozen=True)
class LicenseRule:
    """``sequence``: sentence identifiers in order. Rules are tried in the
    order in which they are listed; ``license`` may come from several.
    ``gap``: other sentences allowed in between, if not the scan's number."""

    license: str
    sequence: tuple[str, ...]
    gap: int | None = None


# Known licence sentences, in normal form, by identifier.
SENTENCES = {
    "APACHE2_LICENSED": ("licensed under the apache license version 2.0",
                         "this work is licensed under the apache license version 2.0"),
    "APACHE2_MAY_NOT": ("you may not use this file except in compliance with the license",),
    "APACHE2_COPY": ("you may obtain a copy of the license at",),
    "AS_IS": ("the software is provided as is without warranty of any kind express or implied",
              "this software is provided as is without any express or implied warranty"),
    "MIT_RELEASED": ("released under the mit license", "licensed under the mit license"),
    "MIT_PERMISSION": ("permission is hereby granted free of charge to any person obtaining a copy of this software",),
    "BSD_REDISTRIBUTION": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "GPL3_LICENSED": ("this work is licensed under the gnu general public license version 3",
                      "licensed under the gnu general public license version 3"),
    "GPL2_LICENSED": ("this work is licensed under the gnu general public license version 2",
                      "licensed under the gnu general public license version 2"),
    "LGPL_LICENSED": ("licensed under the gnu lesser general public license",),
    "CC_BY_LICENSED": ("licensed under cc by 4.0",),
    "CC_BY_SA_LICENSED": ("licensed under cc by sa 4.0",),
    "CC_BY_NC_LICENSED": ("licensed under cc by nc 4.0",),
    "CC0_DEDICATED": ("dedicated to the public domain under cc0 1.0",),
    "ALL_RIGHTS": ("all rights reserved",),
}

# Longer rules come first: they are the more certain evidence.
RULES = (
    LicenseRule("Apache-2.0", ("APACHE2_LICENSED", "APACHE2_MAY_NOT", "APACHE2_COPY")),
    LicenseRule("MIT", ("MIT_PERMISSION", "AS_IS")),
    LicenseRule("MIT", ("MIT_RELEASED", "AS_IS")),
    LicenseRule("BSD", ("BSD_REDISTRIBUTION", "AS_IS")),
    LicenseRule("Apache-2.0", ("APACHE2_LICENSED",)),
    LicenseRule("MIT", ("MIT_RELEASED",)),
    LicenseRule("GPL-3.0", ("GPL3_LICENSED",)),
    LicenseRule("GPL-2.0", ("GPL2_LICENSED",)),
    LicenseRule("LGPL", ("LGPL_LICENSED",)),
    LicenseRule("CC-BY-NC-4.0", ("CC_BY_NC_LICENSED",)),
    LicenseRule("CC-BY-SA-4.0", ("CC_BY_SA_LICENSED",)),
    LicenseRule("CC-BY-4.0", ("CC_BY_LICENSED",)),
    LicenseRule("CC0-1.0", ("CC0_DEDICATED",)),
    LicenseRule("proprietary", ("ALL_RIGHTS",)),
)

_UNDER = (r"(?<!\bnot )(?<!\bnever )\b(?:(?:dual |multi |re)?licen[sc]ed|released|distributed|available|published|covered|governed) "
          r"(?:to you )?(?:under|by) (?:the )?(?:terms of )?(?:either )?(?:an? |the )?")
_SPDX = r"\bspdx license identifier (?:[a-z0-9. ]{1,60} (?:or|and) )?"
_END = r"(?![.0-9a-z])"
_ANY_LATER = r"(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)"
_WORDS = {"GPL": r"(?:gnu )?(?:general public licen[sc]e|gpl)", "AGPL": r"(?:gnu )?(?:affero general public licen[sc]e|agpl)",
          "LGPL": r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)"}


def _gnu() -> dict[str, tuple[str, ...]]:
    """Phrases of the GNU licences: header, short form and SPDX line, by
    version, for that version only and with later ones."""
    out = {}
    for family, versions in (("GPL", ("2", "3")), ("LGPL", ("2", "2.1", "3")), ("AGPL", ("3",))):
        name = _WORDS[family]
        for v in versions:
            number = v.replace(".", r"\.") + (r"(?:\.0)?" if "." not in v else "") + _END
            spdx = _SPDX + family.lower() + " " + (v if "." in v else v + ".0").replace(".", r"\.")
            header = r"\bmodify (?:it|this [a-z]+) under the terms of (?:version " + number + " of )?the " + name
            header += r"(?: as published by the free software foundation)?(?: either)?(?: version)?"
            short = _UNDER + name + r"(?: version)?"
            key = f"{family}{v.replace('.', '')}"
            out[f"{key}_OR_LATER"] = (f"{header} {number}{_ANY_LATER}", f"{short} v?{number}{_ANY_LATER}", f"{spdx} or later")
            only = r"(?! or (?:at your option )?(?:any )?(?:later|newer))(?! of the license or)"
            out["GPL%s_LICENSED" % v if family == "GPL" else f"{key}_ONLY"] = (
                f"{header} {number}{only}", f"{short} v?{number}{only}", f"{spdx}(?: only)?{_END}(?! or later)")
    return out


# Published notices: phrases over normalised words, by identifier.
NOTICES = {
    "APACHE2_LICENSED": (_UNDER + r"apache(?: software)? licen[sc]e(?: version)? v?2(?:\.0)?" + _END,
                         _UNDER + r"apache 2(?:\.0)? licen[sc]e",
                         r"\blicenses? this file to you under the apache license version 2\.0", _SPDX + r"apache 2\.0"),
    "APACHE2_MAY_NOT": (r"\byou may not use this file except in compliance with the license",),
    "APACHE2_COPY": (r"\byou may obtain a copy of the license at",),
    "AS_IS": (r"\b(?:the|this) software is provided (?:by (?:[a-z0-9.]+ ){1,16})?as is\b",),
    "MIT_RELEASED": (_UNDER + r"(?:mit|expat|mit x11) licen[sc]e", _SPDX + "mit" + _END),
    "MIT_PERMISSION": (r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software",),
    "BSD_REDISTRIBUTION": (r"\bredistribution and use in source and binary forms with or without modification are permitted",),
    "BSD_LICENSED": (_UNDER + r"(?:(?:new|modified|simplified|revised|[0-4] clause) )*bsd(?: [0-4] clause)?(?: style)? licen[sc]e",
                     _SPDX + "bsd [0-4] clause"),
    "ISC_PERMISSION": (r"\bpermission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",),
    "ISC_LICENSED": (_UNDER + "isc licen[sc]e", _SPDX + "isc" + _END),
    "MPL2_LICENSED": (r"\bsubject to the terms of the mozilla public license v(?:ersion)? ?2\.0",
                      _UNDER + r"mozilla public licen[sc]e(?: version)? v?2(?:\.0)?" + _END, _SPDX + r"mpl 2\.0"),
    "UNLICENSE": (r"\bthis is free and unencumbered software released into the public domain", _SPDX + "unlicense"),
    "CC_BY_LICENSED": (_UNDER + r"(?:cc by|creative commons attribution(?: cc by)?)(?: version)? 4\.0", _SPDX + r"cc by 4\.0"),
    "CC_BY_SA_LICENSED": (_UNDER + r"(?:cc by sa|creative commons attribution share ?alike(?: cc by sa)?)(?: version)? 4\.0",
                          _SPDX + r"cc by sa 4\.0"),
    "CC_BY_NC_LICENSED": (_UNDER + r"(?:cc by nc|creative commons attribution non ?commercial(?: cc by nc)?)(?: version)? 4\.0",
                          _SPDX + r"cc by nc 4\.0"),
    "CC0_DEDICATED": (r"\bdedicated to the public domain (?:under|by|using|via) (?:the )?(?:creative commons )?cc0",
                      _UNDER + r"(?:creative commons )?(?:cc0|zero)(?: v?1\.0)?", _SPDX + r"cc0 1\.0"),
    "ALL_RIGHTS": (r"\ball rights reserved\b",),
    "LGPL_LICENSED": (_UNDER + _WORDS["LGPL"] + r"\b(?! (?:version )?v?[0-9])",),
    **_gnu(),
}

# A notice with this evidence is a licence though all rights are reserved.
NOTICE_RULES = (
    LicenseRule("MIT", ("MIT_PERMISSION", "AS_IS"), 40),
    LicenseRule("BSD", ("BSD_REDISTRIBUTION", "AS_IS"), 60),
    LicenseRule("ISC", ("ISC_PERMISSION", "AS_IS"), 20),
    LicenseRule("Apache-2.0", ("APACHE2_LICENSED", "APACHE2_MAY_NOT", "APACHE2_COPY"), 10),
    LicenseRule("BSD", ("BSD_LICENSED",)),
    LicenseRule("ISC", ("ISC_LICENSED",)),
    LicenseRule("MPL-2.0", ("MPL2_LICENSED",)),
    LicenseRule("Unlicense", ("UNLICENSE",)),
    *(LicenseRule(f"{f}-{v}{end}", (i,)) for f, v, end, i in (
        ("GPL", "3.0", "-or-later", "GPL3_OR_LATER"), ("GPL", "2.0", "-or-later", "GPL2_OR_LATER"),
        ("LGPL", "3.0", "-or-later", "LGPL3_OR_LATER"), ("LGPL", "2.1", "-or-later", "LGPL21_OR_LATER"),
        ("LGPL", "2.0", "-or-later", "LGPL2_OR_LATER"), ("LGPL", "3.0", "", "LGPL3_ONLY"), ("LGPL", "2.1", "", "LGPL21_ONLY"),
        ("LGPL", "2.0", "", "LGPL2_ONLY"), ("AGPL", "3.0", "-or-later", "AGPL3_OR_LATER"), ("AGPL", "3.0", "", "AGPL3_ONLY"))),
)
NOTICE_LINES = 12  # lines over which one phrase may run
# Texts and lines without any of these hold and begin no phrase.
NOTICE_TEXT = (r"licen[sc]e|gpl|spdx|cc0|cc\W+by|creative\W+commons|public\W+domain|permission\W+(?:is\W+hereby|to\W+use)"
               r"|redistribution\W+and\W+use|all\W+rights\W+reserved|software\W+is\W+provided")
NOTICE_START = (r"\b(?:(?:(?:dual |multi |re)?licen[sc]ed|released|distributed|available|published|covered|governed)(?: to(?: you)?)?(?: under| by|$)"
                r"|(?:dual|multi)$|licenses?(?: this|$)|modify(?: it| this|$)|spdx|you(?: may|$)|permission(?: is| to|$)"
                r"|redistribution(?: and|$)|subject(?: to|$)|this(?: is free| is$| software|$)|the(?: software|$)|dedicated(?: to|$)|all(?: rights|$))")

# A sentence ends at a newline, or at . ! ? ; before white space or the end.
SENTENCE_END = r"\n|[.!?;]+([ \t\x0B-\x0D]|$)"
# Whatever is no letter or digit separates words, but a dot inside a number.
NOT_WORD = r"[^a-z0-9.]+|\.+([^0-9.]|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cue(sentences: dict) -> str:
    """Words of which each known sentence has one: lines without any are no
    licence sentences and need not be normalised."""
    return "|".join(sorted({min(s.split(), key=lambda w: (w not in _CUES, s.split().index(w)))
                            for forms in sentences.values() for s in forms}))


_CUES = ("licensed", "license", "provided", "permission", "redistribution", "dedicated", "rights")


def normal_form(sentence: Column) -> Column:
    """Lower-cased words, one space between them."""
    s = F.translate(sentence, _UPPER, _LOWER)
    return F.trim(F.regexp_replace(F.regexp_replace(s, NOT_WORD, " $1"), " +", " "))


def sentence_ids(text: Column, sentences: dict[str, tuple[str, ...]] = SENTENCES) -> Column:
    """``array<struct(at, id)>``: known sentences of a text in order, ``at``
    their place among the text's sentences that are not blank."""
    table = F.create_map(*[F.lit(x) for i, forms in sentences.items() for f in forms for x in (f, i)])
    cue = _cue(sentences)
    whole = F.coalesce(text, F.lit(""))
    parts = F.filter(F.split(whole, SENTENCE_END), lambda s: F.trim(s) != "")
    found = F.transform(parts, lambda s, i: F.struct(
        i.alias("at"), F.when(F.translate(s, _UPPER, _LOWER).rlike(cue), F.element_at(table, normal_form(s))).alias("id")))
    known = F.filter(found, lambda x: x["id"].isNotNull())
    # most texts hold no cue at all: they are not even cut
    return F.when(F.translate(whole, _UPPER, _LOWER).rlike(cue), known).otherwise(
        F.array().cast("array<struct<at:int,id:string>>"))


def notice_ids(text: Column, notices: dict[str, tuple[str, ...]] = NOTICES) -> Column:
    """``array<struct(at, id)>``: published notices of a text, ``at`` the
    sentence in which each begins, counted as in ``sentence_ids``."""
    whole = F.coalesce(text, F.lit(""))
    forms = F.transform(F.filter(F.split(whole, SENTENCE_END), lambda s: F.trim(s) != ""), normal_form)
    every = "|".join(f"(?:{x})" for phrases in notices.values() for x in phrases)
    none = F.array().cast("array<struct<at:int,id:string>>")

    def found(ahead: Column, i: Column, size: Column) -> Column:
        def at(phrases: tuple[str, ...]) -> Column:
            return F.regexp_instr(ahead, F.lit("|".join(f"(?:{x})" for x in phrases)))
        each = [F.when(at(p).between(1, size), F.struct(i.alias("at"), F.lit(k).alias("id"))) for k, p in notices.items()]
        return F.when(ahead.rlike(every), F.filter(F.array(*each), lambda x: x.isNotNull())).otherwise(none)

    def line(f: Column, s: Column, i: Column) -> Column:
        ahead = F.array_join(F.slice(f, i + 1, F.lit(NOTICE_LINES)), " ")
        # bound once: the phrases look at the joined lines many times
        return F.when(s.rlike(NOTICE_START), F.flatten(F.transform(F.array(ahead), lambda a: found(a, i, F.length(s))))).otherwise(none)
    lines = F.flatten(F.transform(F.array(forms), lambda f: F.flatten(F.transform(f, lambda s, i: line(f, s, i)))))
    return F.when(F.translate(whole, _UPPER, _LOWER).rlike(NOTICE_TEXT), lines).otherwise(none)


def all_ids(known: Column, noticed: Column) -> Column:
    """Both in order; a sentence of the table is not noticed again."""
    new = F.filter(noticed, lambda x: ~F.exists(known, lambda y: y["at"] == x["at"]))
    return F.array_sort(F.concat(known, new), lambda a, b: a["at"] - b["at"])


def _rule_at(ids: str, rule: LicenseRule, gap: int) -> str:
    """SQL for the first place where a rule matches the identifier sequence
    (its first sentence's number), or null. Each step needs its identifier
    next in the known sequence, at most ``gap`` other sentences later."""
    gap = gap if rule.gap is None else rule.gap
    steps = " AND ".join(
        [f"x.id = '{rule.sequence[0]}'"]
        + [f"get({ids}, i + {k}).id = '{s}' AND get({ids}, i + {k}).at - get({ids}, i + {k - 1}).at <= {gap + 1}"
           for k, s in enumerate(rule.sequence[1:], 1)])
    return f"get(filter({ids}, (x, i) -> {steps}), 0).at"


def scan_licenses(df: DataFrame, rules: tuple[LicenseRule, ...] = RULES, sentences: dict = SENTENCES,
                  gap: int = 1, text: str = "text", doc_id: str = "doc_id", notices: dict = NOTICES,
                  notice_rules: tuple[LicenseRule, ...] = NOTICE_RULES) -> DataFrame:
    """``(doc_id, sentence_ids, licenses, first_sentence)``, one row per row.

    ``sentence_ids`` is the sequence of known sentences, joined by spaces;
    ``licenses`` the licences whose rules match, in the order of the rules,
    each once, joined by spaces (empty without any), no ``proprietary``
    beside a published licence; ``first_sentence`` the
    number of the earliest matching sentence, or null. A null or empty text
    has none; repeated rows are scanned alike; an empty table gives no
    rows; other columns are not read.
    """
    rows = df.select(col(doc_id).alias("doc_id"), sentence_ids(col(text), sentences).alias("known"),
                     notice_ids(col(text), notices).alias("noticed"))
    rows = rows.select("doc_id", F.when(F.size("noticed") > 0, all_ids(F.col("known"), F.col("noticed")))
                       .otherwise(F.col("known")).alias("ids"))
    at = [(r.license, F.expr(f"CASE WHEN size(ids) > 0 THEN {_rule_at('ids', r, gap)} END")) for r in (*rules, *notice_rules)]
    # published copyright lines reserve all rights above a licence
    free = F.coalesce(*[a for _, a in at[len(rules):]], F.lit(None)).isNotNull()
    hits = F.array(*[F.struct(F.lit(n).alias("license"), (F.when(~free, a) if n == "proprietary" else a).alias("at")) for n, a in at])
    rows = rows.withColumn("hits", F.when(F.size("ids") > 0, F.filter(hits, lambda x: x["at"].isNotNull())))
    return rows.select("doc_id", F.coalesce(F.array_join("ids.id", " "), F.lit("")).alias("sentence_ids"),
                       F.coalesce(F.array_join(F.array_distinct("hits.license"), " "), F.lit("")).alias("licenses"),
                       F.array_min("hits.at").cast("bigint").alias("first_sentence"))
