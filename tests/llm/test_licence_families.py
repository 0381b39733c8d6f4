"""Headers as they stand in source files."""

from mailtriage.llm import licence_rules as L
from tests.llm.test_licence_rules import found

APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
"""
GPL2 = AGPL.replace("Affero ", "").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
BSD = """Copyright (c) 2011, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def commented(text, sign):
    return "\n".join(f"{sign} {line}".rstrip() for line in text.split("\n"))


def test_headers(spark):
    cases = [
        (APACHE, ["apache-2.0"], "apache-header*1"), (commented(APACHE, " *"), ["apache-2.0"], "apache-header*1"), (commented(APACHE, "#").replace("http:", "https:"), ["apache-2.0"], "apache-header*1"),
        (LGPL, ["lgpl-2.1-or-later"], "lgpl-2.1-header*1"), (AGPL, ["agpl-3.0-or-later"], "agpl-3-header*1"), (commented(GPL2, "//"), ["gpl-2.0-or-later"], "gpl-2-header*1"),
        (MPL, ["mpl-2.0"], None), (BSD, ["bsd-2-clause"], "bsd-2-text*1"), (ZLIB, ["zlib"], "zlib-text*1"),
        ("Copyright 2001 Us. All rights reserved.", ["all-rights-reserved"], "all-rights*1"),
        ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", ["gpl-2.0-only"], "spdx-line*1"), ("# SPDX-License-Identifier: MIT", ["mit"], "spdx-line*1"),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", ["apache-2.0"], "apache-text*1"),
        ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", ["gpl-3.0"], "gpl-3-text*1"),
        ("Distributed under the Boost Software License, Version 1.0.", ["boost-1.0"], "boost-notice*1"), ("CC0 1.0 Universal", ["cc0-1.0"], "cc0-title*1"),
        ("Das geht nur mit: MIT.", [], None),
    ]
    got = found(spark, *[x for x, _, _ in cases])
    for (text, licences, rule), (names, rules) in zip(cases, got):
        assert names == licences and (rule is None or rule in rules), (text, names, rules)


def test_table_is_normalised():
    import re
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in L.SENTENCES.values())
    assert len(set(L.SENTENCES.values())) == len(L.SENTENCES)
    several = [len(r) > 1 for _, _, r in L.RULES]
    assert several == sorted(several, reverse=True)
