"""Licence notices and texts for the licence scan, most of them built by rule.

Fixed values: names, identifiers and public notices of the licences as their stewards ask for them to be put into works (the GNU
project's and the Apache Foundation's notices, the Creative Commons deed lines, SPDX identifiers) and the whole texts of the short
permissive licences.  ``<name>`` stands for the holder and is left out.
"""

from __future__ import annotations

#: Identifiers of the SPDX list that are two words at least (a shingle is five).
SPDX = (
    "AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause "
    "BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 "
    "CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only "
    "GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND-sell-variant IPL-1.0 LGPL-2.0-only "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL "
    "MulanPSL-2.0 ODbL-1.0 ODC-By-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.01 PolyForm-Noncommercial-1.0.0 Python-2.0 QPL-1.0 RPL-1.5 "
    "SSPL-1.0 UPL-1.0 Unicode-3.0 Unicode-DFS-2016 W3C-20150513 ZPL-2.1").split()

#: Names as they stand in one-line grants.
NAMES = {
    "mit": "MIT License", "isc": "ISC License", "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License",
    "bsd-new": "New BSD License", "bsd": "BSD License", "apache-2.0": "Apache License, Version 2.0", "apache-2.0-short": "Apache License 2.0",
    "mpl-2.0": "Mozilla Public License 2.0", "mpl-2.0-long": "Mozilla Public License, version 2.0", "epl-2.0": "Eclipse Public License 2.0",
    "epl-1.0": "Eclipse Public License 1.0", "gpl": "GNU General Public License", "gpl-2.0": "GNU General Public License v2.0",
    "gpl-3.0": "GNU General Public License v3.0", "gpl-2.0-long": "GNU General Public License, version 2",
    "gpl-3.0-long": "GNU General Public License, version 3", "lgpl-2.1": "GNU Lesser General Public License v2.1",
    "lgpl-3.0": "GNU Lesser General Public License v3.0", "agpl-3.0": "GNU Affero General Public License v3.0",
    "gfdl-1.3": "GNU Free Documentation License 1.3", "bsl-1.0": "Boost Software License 1.0", "zlib": "zlib License", "ofl-1.1":
    "SIL Open Font License 1.1", "artistic-2.0": "Artistic License 2.0", "cddl-1.0": "Common Development and Distribution License",
    "cpl-1.0": "Common Public License", "eupl-1.2": "European Union Public Licence 1.2", "ms-pl": "Microsoft Public License",
    "odbl": "Open Database License", "osl-3.0": "Open Software License 3.0", "psf": "Python Software Foundation License",
    "unlicense": "The Unlicense", "wtfpl": "Do What The Fuck You Want To Public License", "sspl": "Server Side Public License",
    "busl": "Business Source License 1.1", "elastic-2.0": "Elastic License 2.0", "ecl-2.0": "Educational Community License",
    "upl": "Universal Permissive License", "ncsa": "University of Illinois NCSA Open Source License", "mulan": "Mulan Permissive Software License",
    "cc0": "Creative Commons CC0 1.0 Universal License", "postgresql": "PostgreSQL License", "lppl": "LaTeX Project Public License",
    "openrail": "CreativeML Open RAIL-M License"}
#: Verbs of one-line grants.
GRANTS = {"licensed": "Licensed under the {}", "released": "Released under the {}", "distributed": "distributed under the terms of the {}",
          "project": "This project is licensed under the {}"}

#: Creative Commons: elements of the name, and what the versions are called.
CC_PARTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
CC_FORMS = {
    "line": "Licensed under CC {code} {version}.",
    "deed": "licensed under a Creative Commons {name} {version} {kind} License",
    "the": "licensed under the Creative Commons {name} {version} {kind} License",
    "url": "http://creativecommons.org/licenses/{path}/{version}/"}

GNU = {"gpl": "General", "lgpl": "Lesser General", "agpl": "Affero General"}
GNU_VERSIONS = (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3"))
GNU_NOTICE = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as "
              "published by the Free Software Foundation, {which}")
GNU_WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
                "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.")
GNU_COPY = ("You should have received a copy of the GNU {name} Public License along with this program. If not, see "
            "<http://www.gnu.org/licenses/>.")
GNU_WORK = "This work is licensed under the GNU {name} Public License, version {version}."

_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
          "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
          "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
             "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
             "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              "from this software without specific prior written permission.")
_BSD_TAIL = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
             "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
             "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
             "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
             "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
             "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
             "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
             "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
             "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")

#: Whole texts and parts of texts, and the notices that their stewards ask for.
TEXTS = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files, to deal in the Software without restriction, including without limitation the rights to "
                 "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-text": f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
                f"copies or substantial portions of the Software. {_AS_IS}",
    "mit-0-text": f"{_MIT}. {_AS_IS}",
    "mit-warranty": _AS_IS,
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                          "that the following conditions are met",
    "bsd-2-clause-text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause-text": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "bsd-warranty": _BSD_TAIL,
    "isc-text": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}",
    "0bsd-text": f"{_ISC}. {_ISC_TAIL}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
                 "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
                 "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
                 "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
                 "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
                 "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
                 "altered from any source distribution.",
    "bsl-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                     "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
                     "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                      "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                      "non-commercial, and by any means.",
    "wtfpl-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as "
                  "long as the name is changed.",
    "postgresql-text": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a "
                       "written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two "
                       "paragraphs appear in all copies.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                           "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                           "language governing permissions and limitations under the License.",
    "asf-notice": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed "
                  "with this work for additional information regarding copyright ownership.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                      "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available "
                      "at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
                      "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "ofl-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at "
                      "https://openfontlicense.org",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gfdl-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version "
                   "1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no "
                   "Back-Cover Texts.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation",
    "gpl-classpath": "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to "
                     "produce an executable, regardless of the license terms of these independent modules",
    "public-domain": "This file has been put into the public domain. You can do whatever you want with this file.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, "
                           "including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the "
                           "publisher"}


def _cc() -> dict[str, str]:
    out = {}
    for kind in CC_KINDS:
        name = "-".join(CC_PARTS[p] for p in kind.split("-"))
        for version, called in CC_VERSIONS.items():
            for form, text in CC_FORMS.items():
                out[f"cc-{kind}-{version}-{form}"] = text.format(code=kind.upper(), version=version, name=name, kind=called, path=kind)
    return out


def _gnu() -> dict[str, str]:
    out = {}
    for family, version in GNU_VERSIONS:
        name, key = GNU[family], f"{family}-{version if '.' in version else version + '.0'}"
        later = f"either version {version} of the License, or (at your option) any later version."
        out[f"{key}-or-later-notice"] = GNU_NOTICE.format(name=name, which=later)
        out[f"{key}-only-notice"] = GNU_NOTICE.format(name=name, which=f"version {version} of the License.")
        out[f"{key}-line"] = GNU_WORK.format(name=name, version=version)
    for family, name in GNU.items():
        out[f"{family}-warranty"] = GNU_WARRANTY.format(name=name)
        out[f"{family}-copy"] = GNU_COPY.format(name=name)
    return out


def templates() -> dict[str, str]:
    """Name -> text of every notice and licence of the list."""
    out = dict(TEXTS) | _cc() | _gnu()
    out |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
    out |= {f"{key}-{verb}": text.format(name) for key, name in NAMES.items() for verb, text in GRANTS.items()}
    return out
