"""Stock licence texts and notices, wrapped, below headings and in comments."""

from impactloom.llm import licenses

MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Copyright (c) 2024, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Copyright 2024 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
WANT = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0": GPL, "MPL-2.0": MPL}


def test_stock_texts(spark):
    layouts = {
        "as it is": lambda t: t,
        "CRLF": lambda t: t.replace("\n", "\r\n"),
        "comment": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint x = 1;\n",
        "narrow": lambda t: "\n".join("" if x == "" else x.replace(" of ", "\nof ") for x in t.splitlines()),
        "one line a paragraph": lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n")),
    }
    rows = [(f"{want}, {name}", f(text)) for want, text in WANT.items() for name, f in layouts.items()]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, _ in rows:
        assert got[name]["licenses"] == name.split(", ")[0], (name, got[name])
    assert got["MIT, as it is"]["sentence_ids"] == "mit-grant,mit-notice,as-is"


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
AGPL = GPL.replace("GNU General", "GNU Affero General", 1)
GPL2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
"""
JSON = MIT.replace("\nTHE SOFTWARE IS", "\nThe Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS")
BSD4 = BSD2 + """
3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
   This product includes software.
"""
MORE = {"LGPL-2.1": LGPL, "AGPL-3.0": AGPL, "GPL-2.0": GPL2, "ISC": ISC, "0BSD": ZERO, "Unlicense": UNLICENSE, "Zlib": ZLIB, "JSON": JSON, "BSD-4-Clause": BSD4}


def test_more_stock_texts(spark):
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(MORE.items()), "doc_id string, text string")).collect()}
    for name in MORE:
        assert got[name]["licenses"] == name, (name, got[name])


def test_every_rule_fits_its_own_sentences(spark):
    rows = [(name, "\n\n".join(licenses.SENTENCES[x].replace(" / ", "; ") + "." for x in needed)) for name, _, needed in licenses.RULES]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, licence, needed in licenses.RULES:
        assert name in got[name]["rules"].split(",") and licence in got[name]["licenses"].split(","), name
        assert got[name]["sentence_ids"].split(",") == needed
    assert len({x for _, x, _ in licenses.RULES}) >= 30


def test_every_sentence_has_an_anchor_and_a_rule():
    assert [n for n, s in licenses.SENTENCES.items() if not any(a in licenses.plain(s) for a in licenses.ANCHORS)] == []
    used = {x for _, _, needed in licenses.RULES for x in needed}
    assert set(licenses.SENTENCES) - used <= {"gpl-everyone", "bsd-disclaimer"}
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
