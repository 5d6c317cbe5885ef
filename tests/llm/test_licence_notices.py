"""Every licence rule on its notice as files carry it: wrapped, numbered, with colons and semicolons, in comments."""

from sheaf.llm import licences

WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
FREE = """This program is free software{}you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
HOPE = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  """
SEE = "See the\nGNU General Public License for more details.\n"
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAME = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\n'
COMPLY = "you may not use this file except in compliance with the License.\n"
OBTAIN = "You may obtain a copy of the License at\n\n"
BASIS = 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n'
GOVERN = "See the License for the specific language governing permissions and\nlimitations under the License.\n"
NOTICES = {
    "RSTU": BSD + NAME, "RST": BSD, "BCDEF": APACHE + COMPLY + OBTAIN + BASIS + GOVERN, "BCDE": APACHE + COMPLY + OBTAIN + BASIS, "BC": APACHE + COMPLY,
    "HIJ": GRANT + "\n" + WARRANTY, "HI": GRANT, "LMN": FREE.format(": ") + HOPE + SEE, "LM": FREE.format("; ") + HOPE, "L": FREE.format(": "),
    "A": "Licensed under the Apache License,\nVersion 2.0.", "B": APACHE, "G": "Released under the\nMIT License.",
    "K": "This work is licensed under the GNU General Public License\nVersion 3.", "O": "Licensed under CC\nBY-NC 4.0.", "P": "Licensed under CC BY 4.0",
    "a": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
    "b": FREE.format(": ").replace("GNU General", "GNU Affero General"), "c": FREE.format("; ").replace("version 3", "version 2"), "cM": FREE.format("; ").replace("version 3", "version 2") + HOPE, "cMN": FREE.format("; ").replace("version 3", "version 2") + HOPE + SEE,
    "d": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "de": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at\n",
    "f": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "g": "This is free and unencumbered software released into the public domain.\n", "h": "To the extent possible under law, the person who associated CC0 with\nthis work has waived all copyright and related or neighboring\nrights to this work.\n",
    "i": "Licensed under CC BY-SA 4.0.", "j": "Distributed under the Boost Software License, Version 1.0.\n",
    "Q": "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", "V": "ALL RIGHTS\nRESERVED.",
}


def test_every_rule_on_its_notice(spark):
    rows = [(f"{rule} {lead}", "".join(lead + line + "\n" for line in text.split("\n"))) for rule, text in NOTICES.items() for lead in ("", "# ", " * ")]
    rows = [*rows, ("cut", "Released under the MIT License\n\nThis program is free software"), ("head", "Heading of\nALL RIGHTS RESERVED\nand more")]
    got = {r["id"]: r for r in licences.scan(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    for rule in licences.RULES:
        for lead in ("", "# ", " * "):
            row = got[f"{rule} {lead}"]
            assert (row["sentence_ids"], row["licences"]) == (rule, [licences.RULES[rule]]), rule
    assert got["LMN "]["verdict"] == "copyleft" and got["RSTU "]["verdict"] == "permissive"
    assert got["cut"]["sentence_ids"] == "G." and got["head"]["sentence_ids"] == ".V."
