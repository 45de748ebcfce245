"""Licences of texts, recognised by sentences and ordered rules; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences, or halves of sentences, of public licences and notices in normalised form (lower case, runs of other
# characters than a-z, 0-9, "." and "+" as one space). A sentence has an identifier if it contains the words.
SENTENCES = (
    ("MitName", "released under the mit license"),
    ("MitName", "licensed under the mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied"),
    ("MitLiability", "in no event shall the authors or copyright holders be liable for any claim"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is"),
    ("ApacheHeader", "licensed under the apache license version 2.0"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "software distributed under the license is distributed on an as is basis"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("Gpl3Name", "licensed under the gnu general public license version 3"),
    ("Gpl2Name", "licensed under the gnu general public license version 2"),
    ("GnuFree", "is free software you can redistribute it and or modify it"),
    ("GplTerms", "under the terms of the gnu general public license"),
    ("LgplTerms", "under the terms of the gnu lesser general public license"),
    ("AgplTerms", "under the terms of the gnu affero general public license"),
    ("GnuOrLater3", "either version 3 of the license or at your option any later version"),
    ("GnuOrLater21", "either version 2.1 of the license or at your option any later version"),
    ("GnuOrLater2", "either version 2 of the license or at your option any later version"),
    ("GnuHope", "in the hope that it will be useful but without any warranty"),
    ("GplSee", "see the gnu general public license for more details"),
    ("LgplSee", "see the gnu lesser general public license for more details"),
    ("AgplSee", "see the gnu affero general public license for more details"),
    ("GplCopy", "you should have received a copy of the gnu general public license"),
    ("LgplCopy", "you should have received a copy of the gnu lesser general public license"),
    ("AgplCopy", "you should have received a copy of the gnu affero general public license"),
    ("MplHeader", "this source code form is subject to the terms of the mozilla public license"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one"),
    ("EplTerms", "made available under the terms of the eclipse public license"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("BoostName", "distributed under the boost software license version 1.0"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
    ("CcByNcSa", "licensed under cc by nc sa 4.0"),
    ("CcByNcNd", "licensed under cc by nc nd 4.0"),
    ("CcByNc", "licensed under cc by nc 4.0"),
    ("CcBySa", "licensed under cc by sa 4.0"),
    ("CcBy", "licensed under cc by 4.0"),
    ("Cc0", "to the extent possible under law"),
    ("PublicDomain", "released into the public domain"),
    ("AllRights", "all rights reserved"),
)
# Licences by the identifiers that stand side by side, longer before shorter.
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitName",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("ApacheHeader", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheHeader", "ApacheUse", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheHeader",)),
    ("AGPL-3.0-or-later", ("GnuFree", "AgplTerms", "GnuOrLater3", "GnuHope", "AgplSee", "AgplCopy")),
    ("AGPL-3.0-or-later", ("GnuFree", "AgplTerms", "GnuOrLater3")),
    ("LGPL-3.0-or-later", ("GnuFree", "LgplTerms", "GnuOrLater3", "GnuHope", "LgplSee", "LgplCopy")),
    ("LGPL-3.0-or-later", ("GnuFree", "LgplTerms", "GnuOrLater3")),
    ("LGPL-2.1-or-later", ("GnuFree", "LgplTerms", "GnuOrLater21", "GnuHope", "LgplSee", "LgplCopy")),
    ("LGPL-2.1-or-later", ("GnuFree", "LgplTerms", "GnuOrLater21")),
    ("GPL-3.0-or-later", ("GnuFree", "GplTerms", "GnuOrLater3", "GnuHope", "GplSee", "GplCopy")),
    ("GPL-3.0-or-later", ("GnuFree", "GplTerms", "GnuOrLater3")),
    ("GPL-2.0-or-later", ("GnuFree", "GplTerms", "GnuOrLater2", "GnuHope", "GplSee", "GplCopy")),
    ("GPL-2.0-or-later", ("GnuFree", "GplTerms", "GnuOrLater2")),
    ("GPL-3.0", ("Gpl3Name",)),
    ("GPL-2.0", ("Gpl2Name",)),
    ("AGPL", ("AgplTerms",)),
    ("LGPL", ("LgplTerms",)),
    ("GPL", ("GplTerms",)),
    ("MPL-2.0", ("MplHeader", "MplCopy")),
    ("MPL-2.0", ("MplHeader",)),
    ("EPL", ("EplTerms",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("BSL-1.0", ("BoostName",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Unlicense", ("UnlicenseFree", "PublicDomain")),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("CC0-1.0", ("Cc0",)),
    ("Public-Domain", ("PublicDomain",)),
    ("Proprietary", ("AllRights",)),
)
#: A text or sentence without any of these words holds none of the above; one word each, which no line break can part.
HINTS = (
    "licen", "copyright", "permi", "redistribut", "domain", "reserved", "provided", "later", "extent", "endorse", "warranty", "mpl", "software",
)
SENTENCE_END = "[.!?]+\\s+|\\n\\s*\\n"
UNKNOWN = "Unknown"


def _hinted(text: Column) -> Column:
    found = F.lit(False)
    for hint in HINTS:
        found = found | F.contains(text, F.lit(hint))
    return found


def normalised(sentence: Column) -> Column:
    """Words of a sentence with a space at each end."""
    words = F.regexp_replace(sentence, "[^a-z0-9.+]+", " ")
    words = F.regexp_replace(words, "licence", "license")
    return F.concat(F.lit(" "), F.regexp_replace(words, "^[ .]+|[ .]+$", ""), F.lit(" "))


def _identifiers(form: Column) -> Column:
    """Identifiers of a normalised sentence in the order of its words."""
    places = F.array(*[
        F.struct(F.instr(form, f" {words} ").alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(SENTENCES)
    ])
    known = F.transform(F.array_sort(F.filter(places, lambda p: p["at"] > 0)), lambda p: p["name"])
    unknown = F.when(F.contains(form, F.lit(" license")), F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(known) > 0, known).otherwise(unknown)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids``, ``licenses`` and ``n_unknown``.

    The text is cut after sentence marks and at blank lines, and a sentence gives the identifiers of all known parts in
    their order; sentences that name a licence but hold none are ``Unknown``, others are passed over. Rules are tried in order on the identifiers
    in text order; one that applies anywhere names its licence and uses up the identifiers wherever they
    stand side by side, so that a shorter rule does not find them again. ``licenses`` holds each licence
    once, in rule order; ``n_unknown`` counts the unknown sentences. Null and empty texts have none.
    Columns of these names are replaced; rows may repeat; an empty table gives an empty one. No row meets
    another: there is no shuffle, whatever the skew.
    """
    lower = F.lower(F.col(text_col))
    forms = F.filter(F.transform(F.split(lower, SENTENCE_END), normalised), _hinted)
    ids = F.flatten(F.transform(forms, _identifiers))
    none = F.array().cast("array<string>")
    rows = docs.withColumn("sentence_ids", F.when(_hinted(lower), ids).otherwise(none))
    rows = rows.withColumn("sentence_ids", F.coalesce("sentence_ids", none))
    rules = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for name, run in RULES
    ])
    written = F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    start = F.struct(written.alias("left"), none.alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["run"])
        return F.struct(
            F.replace(state["left"], rule["run"], F.lit("|")).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    found = F.array_distinct(F.aggregate(rules, start, apply)["found"])
    return rows.withColumns({
        "licenses": F.when(F.size("sentence_ids") > 0, found).otherwise(none),
        "n_unknown": F.size(F.filter("sentence_ids", lambda i: i == UNKNOWN)),
    })


def oracle_sql() -> str:
    """The same on DuckDB, one column per rule."""
    hinted = " OR ".join("contains({0}, '" + h + "')" for h in HINTS)
    places = ", ".join(f"{{'at': instr(f, ' {words} '), 'k': {k}, 'name': '{name}'}}" for k, (name, words) in enumerate(SENTENCES))
    known = f"list_transform(list_sort(list_filter([{places}], lambda p: p.at > 0)), lambda p: p.name)"
    steps, left = [], "s0"
    for k, (_, run) in enumerate(RULES, 1):
        pattern = "".join(f"<{i}>" for i in run)
        steps.append(f"contains({left}, '{pattern}') AS h{k}, replace({left}, '{pattern}', '|') AS s{k}")
        left = f"s{k}"
    hits = ", ".join(f"CASE WHEN h{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES, 1))
    nl = chr(92) + "n"
    return rf"""
WITH cut AS (
  SELECT doc_id, CASE WHEN {hinted.format('lower(text)')} THEN string_split_regex(lower(text), '[.!?]+\s+|{nl}\s*{nl}') ELSE [] END AS parts
  FROM documents
), forms AS (
  SELECT doc_id, list_filter(list_transform(coalesce(parts, []), lambda x:
           ' ' || regexp_replace(replace(regexp_replace(x, '[^a-z0-9.+]+', ' ', 'g'), 'licence', 'license'), '^[ .]+|[ .]+$', '', 'g') || ' '),
         lambda x: {hinted.format('x')}) AS forms
  FROM cut
), named AS (
  SELECT doc_id, flatten(list_transform(forms, lambda f: CASE WHEN length({known}) > 0 THEN {known}
         WHEN contains(f, ' license') THEN ['{UNKNOWN}'] ELSE [] END)) AS ids
  FROM forms
), ruled AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS s0, {', '.join(steps)}
  FROM named
), found AS (
  SELECT doc_id, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS names FROM ruled
)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses,
       len(list_filter(ids, lambda i: i = '{UNKNOWN}'))::INT AS n_unknown
FROM found
"""
