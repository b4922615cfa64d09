"""Unmodified standard notices, wrapped as they come."""

from loomgraph.llm import licenses

APACHE = """# Copyright 2020 Example
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
MIT = """Copyright (c) 2020 Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice
"""
BSD = """Redistribution and use are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


BSD3 = """Copyright (c) 2020, Example
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

""" + BSD.split("\n\n", 1)[1] + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; version 2 of the License.
"""
ZLIB = """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def test_standard_notices(spark):
    d = spark.createDataFrame(list(enumerate([APACHE, GPL, MIT, BSD, "We like the MIT License a lot."])), "doc_id long, text string")
    got = licenses.scan(d).orderBy("doc_id").select("licenses", "sentence_ids").collect()
    assert [r[0] for r in got] == [["Apache-2.0"], ["GPL-3.0-or-later"], ["MIT"], ["BSD"], []]
    assert got[0][1] == ["apache.name", "apache.use"]


def test_more_notices(spark):
    texts = {
        BSD3: ["BSD-3-Clause"], LGPL: ["LGPL-2.1-or-later"], GPL2: ["GPL-2.0-only"], GPL2.replace("version 2", "either version 2").replace("License.", "License, or\n * (at your option) any later version."): ["GPL-2.0-or-later"],
        GPL.replace("GNU ", "GNU Affero "): ["AGPL-3.0-or-later"], ZLIB: ["Zlib"], "Some code.\n// SPDX-License-Identifier: BSD-2-Clause\nint x;": ["BSD-2-Clause"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        "// Distributed under the Boost Software License, Version 1.0. (See accompanying file)": ["BSL-1.0"], "Copyright 2020 Example. All rights reserved.\n\n" + MIT: ["MIT"],
        "Copyright 2020 Example. All rights reserved.": ["proprietary"], MIT + "\n\n" + LGPL: ["LGPL-2.1-or-later", "MIT"],
    }
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(d).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == list(texts.values())


def test_tables_are_whole():
    """Every identifier of a rule has a sentence, every sentence one identifier, and every identifier but parts of longer rules a rule."""
    pairs = [*licenses.SENTENCES.items(), *((k, v) for k, more in licenses.VARIANTS.items() for v in more)]
    owner = {}
    for k, v in pairs:
        assert owner.setdefault(v, k) == k and v == v.lower().strip()
    used = {i for _, _, seq in licenses.RULES for i in seq}
    assert used == {k for k, _ in pairs}
    assert len(licenses.RULES) < 200 and len(owner) < 200


def test_rules_match_a_plain_reading(spark):
    """Random sequences of known sentences, one a line, against a loop over the ordered rules."""
    import random

    pairs = [(k, v) for k, v in licenses.SENTENCES.items()] + [(k, v) for k, more in licenses.VARIANTS.items() for v in more]
    rng, texts, want = random.Random(4), [], []
    for _ in range(150):
        picked = [rng.choice(pairs) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.5:
            picked += [(i, next(v for k, v in pairs if k == i)) for i in rng.choice(licenses.RULES)[2]]
        texts.append("\n\n".join(v for _, v in picked))
        left, hits = [k for k, _ in picked], []
        for name, kind, seq in licenses.RULES:
            at, found = 0, False
            while at + len(seq) <= len(left):
                if left[at : at + len(seq)] == seq:
                    left[at : at + len(seq)], found = [None], True
                at += 1
            if found and (kind != "reserved" or not hits):
                hits.append(name)
        want.append(sorted(set(hits)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[0] for r in licenses.scan(d).orderBy("doc_id").select("licenses").collect()] == want
