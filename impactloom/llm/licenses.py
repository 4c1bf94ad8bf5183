"""Licence recognition by sentence rules, native to Spark SQL.

A text is normalised to words, sentence ends and line breaks.  A known sentence is found where it stands
between two of these (or the text's beginning and end), whether it is wrapped over lines, indented,
commented out, or goes on after a ':', ';' or '.' of its own.  Found ones give their identifiers in order of
place, and ordered rules over these identifiers name licences.  Of sentences that begin at one place the
longest counts.  Texts without any word that all known sentences have one of are not searched.  All of it
happens within a row, so nothing is shuffled.

The SQL splits at sentence ends and line breaks, or at sentence ends only.  It finds the same in one-line notices,
but not in wrapped licence texts below a heading.

A null or empty text has no sentences; texts are read whole; repeated rows, identifiers and extra columns do
not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Sentences of well-known licences and notices, normalised, by identifier.  A / stands where one has a
# sentence end of its own inside.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-the-license": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-program": "this program is free software / you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty / without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v / 2 0",
    "mpl-1-1": "the contents of this file are subject to the mozilla public license version 1 1 the license / you may not use this file except in compliance with the license",
    "isc-licensed": "licensed under the isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "author-disclaims": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd-3-licensed": "licensed under the bsd 3 clause license",
    "bsd-2-licensed": "licensed under the bsd 2 clause license",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2-title": "apache license version 2 0 january 2004",
    "apache-2-terms": "terms and conditions for use reproduction and distribution",
    "apache-2-copyright-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-2-program": "this program is free software / you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation / either version 2 of the license or at your option any later version",
    "gpl-2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-2-title": "gnu general public license version 2 june 1991",
    "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "gpl-everyone": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-3-copyleft": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-2-freedom": "the licenses for most software are designed to take away your freedom to share and change it",
    "lgpl-2-1-library": "this library is free software / you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation / either version 2 1 of the license or at your option any later version",
    "lgpl-3-library": "this library is free software / you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation / either version 3 of the license or at your option any later version",
    "lgpl-3-incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty / without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-3-program": "this program is free software / you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-copyleft": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-dedicated": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "cc-by-nd-4": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-4": "licensed under cc by nc nd 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-4-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-sa-3-work": "this work is licensed under a creative commons attribution sharealike 3 0 unported license",
    "epl-2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1-program": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "zlib-held": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-granted": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented / you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "bsl-1-notice": "distributed under the boost software license version 1 0",
    "bsl-1-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl-want": "you just do what the fuck you want to",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ncsa-deal": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "ms-pl-governs": "this license governs use of the accompanying software",
    "ms-pl-accept": "if you use the software you accept this license",
    "cddl-1-terms": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "ofl-1-1": "this font software is licensed under the sil open font license version 1 1",
    "json-good": "the software shall be used for good not evil",
    "psf-agreement": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
    "eupl-1-2": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the license",
    "afl-3": "licensed under the academic free license version 3 0",
    "osl-3": "licensed under the open software license version 3 0",
    "upl-1": "the universal permissive license upl version 1 0",
    "upl-grant": "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights in the software and any and all patent rights owned or freely licensable by each licensor hereunder covering either i the unmodified software as contributed to or provided by such licensor or ii the larger works as defined below to deal in both",
    "sspl-1": "this program is free software / you can redistribute it and or modify it under the terms of the server side public license version 1 as published by mongodb inc",
    "busl-1-1": "business source license 1 1",
    "busl-grant": "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
    "beerware": "as long as you retain this notice you can do whatever you want with this stuff",
}
# Rules in order of precedence, with the sentences that must follow one another.
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice"]),
    ("mit-released", "MIT", ["mit-released"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("json-text", "JSON", ["mit-grant", "mit-notice", "json-good"]),
    ("mit-0-text", "MIT-0", ["mit-0-grant", "as-is"]),
    ("apache-header", "Apache-2.0", ["apache-2-the-license", "apache-compliance"]),
    ("apache-notice", "Apache-2.0", ["apache-2"]),
    ("apache-copy-notice", "Apache-2.0", ["apache-compliance", "apache-copy", "apache-as-is"]),
    ("apache-text", "Apache-2.0", ["apache-2-copyright-grant", "apache-as-is"]),
    ("apache-terms", "Apache-2.0", ["apache-2-title", "apache-2-terms"]),
    ("gpl-work", "GPL-3.0", ["gpl-3-work"]),
    ("gpl-header", "GPL-3.0", ["gpl-3-program", "gpl-warranty"]),
    ("gpl-3-text", "GPL-3.0", ["gpl-everyone", "gpl-3-copyleft"]),
    ("gpl-3-titled", "GPL-3.0", ["gpl-3-title"]),
    ("gpl-2-work", "GPL-2.0", ["gpl-2-work"]),
    ("gpl-2-header", "GPL-2.0", ["gpl-2-program", "gpl-warranty"]),
    ("gpl-2-text", "GPL-2.0", ["gpl-everyone", "gpl-2-freedom"]),
    ("gpl-2-titled", "GPL-2.0", ["gpl-2-title"]),
    ("lgpl-2-1-header", "LGPL-2.1", ["lgpl-2-1-library", "lgpl-warranty"]),
    ("lgpl-3-header", "LGPL-3.0", ["lgpl-3-library", "lgpl-warranty"]),
    ("lgpl-3-text", "LGPL-3.0", ["lgpl-3-incorporates"]),
    ("agpl-3-header", "AGPL-3.0", ["agpl-3-program", "gpl-warranty"]),
    ("agpl-3-text", "AGPL-3.0", ["gpl-everyone", "agpl-3-copyleft"]),
    ("bsd-4-text", "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsd-3-licensed", "BSD-3-Clause", ["bsd-3-licensed"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-2-licensed", "BSD-2-Clause", ["bsd-2-licensed"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("isc-licensed", "ISC", ["isc-licensed"]),
    ("0bsd-text", "0BSD", ["0bsd-grant", "author-disclaims"]),
    ("cc-by", "CC-BY-4.0", ["cc-by-4"]),
    ("cc-by-work", "CC-BY-4.0", ["cc-by-4-work"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("cc-by-sa-work", "CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("cc-by-nd", "CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("cc-by-nd-work", "CC-BY-ND-4.0", ["cc-by-nd-4-work"]),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("cc-by-sa-3", "CC-BY-SA-3.0", ["cc-by-sa-3-work"]),
    ("cc0-waived", "CC0-1.0", ["cc0-waiver"]),
    ("cc0-deed", "CC0-1.0", ["cc0-dedicated"]),
    ("mpl", "MPL-2.0", ["mpl-2"]),
    ("mpl-1-1", "MPL-1.1", ["mpl-1-1"]),
    ("epl-2-header", "EPL-2.0", ["epl-2-terms"]),
    ("epl-1-header", "EPL-1.0", ["epl-1-program"]),
    ("unlicense-text", "Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("unlicense-line", "Unlicense", ["unlicense-domain"]),
    ("zlib-text", "Zlib", ["zlib-held", "zlib-granted", "zlib-origin", "zlib-altered"]),
    ("bsl-notice", "BSL-1.0", ["bsl-1-notice"]),
    ("bsl-text", "BSL-1.0", ["bsl-1-grant"]),
    ("wtfpl-text", "WTFPL", ["wtfpl-want"]),
    ("postgresql-text", "PostgreSQL", ["postgresql-grant"]),
    ("ncsa-text", "NCSA", ["ncsa-deal", "bsd-source", "bsd-binary"]),
    ("ms-pl-text", "MS-PL", ["ms-pl-governs", "ms-pl-accept"]),
    ("cddl-header", "CDDL-1.0", ["cddl-1-terms"]),
    ("ofl-text", "OFL-1.1", ["ofl-1-1"]),
    ("psf-text", "PSF-2.0", ["psf-agreement"]),
    ("eupl-header", "EUPL-1.2", ["eupl-1-2"]),
    ("afl-notice", "AFL-3.0", ["afl-3"]),
    ("osl-notice", "OSL-3.0", ["osl-3"]),
    ("upl-text", "UPL-1.0", ["upl-1", "upl-grant"]),
    ("sspl-header", "SSPL-1.0", ["sspl-1", "gpl-warranty"]),
    ("busl-text", "BUSL-1.1", ["busl-1-1", "busl-grant"]),
    ("beerware-notice", "Beerware", ["beerware"]),
]
# Every known sentence has one of these; texts with none are not searched further.
ANCHORS = ["licens", "licenc", "permi", "warrant", "software", "distribut", "copyright", "advertising", "misrepresented", "retain", "fuck"]
#: The same of two words and more: a frequent word of them, and the words with anything between, as lines may be broken there.
LONG_ANCHORS = [("domain", "public[^a-z0-9]+domain")]
_END = "[.!?:;]+[ \\t\\n\\x0B\\f\\r]+"
_MARK, _LINE = "\x01", "\x02"


def plain(sentence: str) -> str:
    """A known sentence without the marks of its inner ends."""
    return sentence.replace(" / ", " ")


def _pattern() -> str:
    """All known sentences, the longest first, between ends."""

    def one(sentence: str) -> str:
        return sentence.replace(" / ", "@").replace(" ", f"[ {_LINE}]+").replace("@", f"[ {_MARK}{_LINE}]+")

    either = "|".join(one(x) for x in sorted(SENTENCES.values(), key=lambda x: -len(x)))
    return f"(?:^|[{_MARK}{_LINE}]) ?({either})(?= ?(?:[{_MARK}{_LINE}]|$))"


def _known(text: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    ids = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (plain(s), name)])

    def of(low: Column) -> Column:
        marked = F.regexp_replace(F.concat(low, F.lit(" ")), _END, _MARK)
        bare = F.regexp_replace(F.regexp_replace(F.translate(marked, "\n", _LINE), "licence", "license"), f"[^a-z0-9{_MARK}{_LINE}]+", " ")
        found = F.regexp_extract_all(bare, F.lit(_pattern()), F.lit(1))
        told = F.transform(found, lambda s: F.element_at(ids, F.regexp_replace(s, f"[ {_MARK}{_LINE}]+", " ")))
        hint = reduce(or_, [low.contains(x) for x in ANCHORS] + [low.contains(word) & low.rlike(pattern) for word, pattern in LONG_ANCHORS])
        return F.when(hint, told).otherwise(F.array().cast("array<string>"))

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def _fits(needed: list[str]) -> Column:
    return F.col("told").like("%" + "%".join(f"<{x}>" for x in needed) + "%")


def _longer(rule: str) -> list[str]:
    """Rules of other licences that need all that ``rule`` needs, in its order, and more."""
    own, licence = next((needed, x) for n, x, needed in RULES if n == rule)

    def within(needed: list[str]) -> bool:
        rest = iter(needed)
        return len(needed) > len(own) and all(any(x == y for y in rest) for x in own)

    return [n for n, x, needed in RULES if x != licence and within(needed)]


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: ``key``, sentence_ids, n_sentences, rules, licenses (comma-joined, rules' order)."""
    rows = df.select(F.col(key).alias("key"), _known(F.col(text)).alias("ids"))
    tagged = rows.select("key", "ids", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("told"))
    fit = [(name, licence, _fits(needed)) for name, licence, needed in RULES]
    # A licence whose longer rule fits is not named again by a part of it.
    fits = {name: c for name, _, c in fit}
    fit = [(n, x, reduce(lambda c, longer: c & ~fits[longer], _longer(n), c)) for n, x, c in fit]
    return tagged.select(
        F.col("key").alias(key),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, _, c in fit])), ",").alias("rules"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(licence)) for _, licence, c in fit]))), ",").alias("licenses"),
    )


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` over the table documents."""
    mapping = "MAP {" + ", ".join(f"'{plain(s)}': '{name}'" for name, s in SENTENCES.items()) + "}"

    def known(ends: str) -> str:
        marked = f"regexp_replace(lower(coalesce(text, '')) || ' ', '{ends}', chr(1), 'g')"
        plain = f"regexp_replace(replace({marked}, 'licence', 'license'), '[^a-z0-9\\x01]+', ' ', 'g')"
        return f"list_filter(list_transform(string_split({plain}, chr(1)), lambda s: m[trim(s)]), lambda s: s IS NOT NULL)"

    def fits(needed: list[str]) -> str:
        like = "%" + "%".join(f"<{x}>" for x in needed) + "%"
        return f"(l LIKE '{like}' OR w LIKE '{like}')"

    fit = [(n, x, fits(s)) for n, x, s in RULES]
    told = {n: c for n, _, c in fit}
    fit = [(n, x, " AND NOT ".join([c, *[told[longer] for longer in _longer(n)]])) for n, x, c in fit]
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in fit)
    licences = list(dict.fromkeys(x for _, x, _ in fit))
    named = ", ".join(f"CASE WHEN {' OR '.join(f'({c})' for _, y, c in fit if y == x)} THEN '{x}' END" for x in licences)
    end = "[.!?:;]+[ \\t\\n\\x0B\\f\\r]+"
    return f"""
WITH k AS (SELECT {mapping} AS m),
s AS (SELECT doc_id, {known(end + '|' + chr(92) + 'n')} AS lines, {known(end)} AS wrapped FROM documents, k),
t AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN lines ELSE wrapped END AS ids,
        array_to_string(list_transform(lines, lambda x: '<' || x || '>'), '') AS l,
        array_to_string(list_transform(wrapped, lambda x: '<' || x || '>'), '') AS w FROM s)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, len(ids)::BIGINT AS n_sentences,
       concat_ws(',', {names}) AS rules, concat_ws(',', {named}) AS licenses FROM t"""
