"""Passages, identifiers and names of public licences that the licence scan looks for: fixed values."""

from __future__ import annotations

import re

#: (label, passage, phrases of it that must stand in a file). The wording of the licences themselves.
#: A licence has one passage or more; each is looked up by itself.
TEXTS = (
    # MIT
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("included in all copies or substantial portions of the software",)),
    # ISC and 0BSD
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted provided that",)),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE", ("with or without fee is hereby granted the software is provided",)),
    # BSD
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution and use in source and binary forms",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software without specific prior written permission",)),
    # Apache
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("except in compliance with the license",)),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("specific language governing permissions and limitations under the license",)),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", ("irrevocable copyright license to reproduce prepare derivative works of",)),
    ("apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.", ("as defined by sections 1 through 9 of this document",)),
    ("apache-2.0", "\"Contribution\" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner", ("intentionally submitted to licensor for inclusion in the work",)),
    # GNU
    ("gpl-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.", ("designed to take away your freedom to share and change the works",)),
    ("gpl-3.0", "To \"propagate\" a work means to do anything with it that, without permission, would make you directly or secondarily liable for infringement under applicable copyright law, except executing it on a computer or modifying a private copy.", ("secondarily liable for infringement under applicable copyright law",)),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it.", ("designed to take away your freedom to share and change it",)),
    ("gpl-2.0", "You may modify your copy or copies of the Program or any portion of it, thus forming a work based on the Program, and copy and distribute such modifications or work under the terms of Section 1 above", ("thus forming a work based on the program",)),
    ("lgpl-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", ("supplemented by the additional permissions listed below",)),
    ("agpl-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.", ("cooperation with the community in the case of network server software",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("you can redistribute it and or modify it under the terms of the gnu general public license",)),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program.", ("received a copy of the gnu general public license",)),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works.", ("general public license is a free copyleft license",)),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    # Mozilla and Eclipse
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("subject to the terms of the mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("under the terms of the eclipse public license",)),
    ("mpl-2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.", ("contributes to the creation of or owns covered software",)),
    ("epl-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", ("of the program constitutes recipient s acceptance of this agreement",)),
    # Creative Commons
    ("cc-by-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License", ("creative commons attribution 4 0 international public license",)),
    ("cc-by-sa-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License", ("creative commons attribution sharealike 4 0 international public license",)),
    ("cc-by-nc-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License", ("creative commons attribution noncommercial 4 0 international public license",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    ("cc0", "Creative Commons CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright and related or neighboring rights",)),
    # others
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software", ("any person or organization obtaining a copy of the software and accompanying documentation",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable",)),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", ("origin of this software must not be misrepresented",)),
    ("wtfpl", "Do What The Fuck You Want To Public License. Everyone is permitted to copy and distribute verbatim or modified copies of this license document", ("want to public license everyone is permitted",)),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ("without a written agreement is hereby granted",)),
)
#: (label, identifier of the SPDX list). Fixed values. "-only" and "-or-later" go with the identifier before them.
SPDX = (
    ("mit", "MIT"), ("isc", "ISC"), ("0bsd", "0BSD"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("bsd-4-clause", "BSD-4-Clause"),
    ("apache-2.0", "Apache-2.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3.0"), ("agpl-3.0", "AGPL-3.0"),
    ("mpl-2.0", "MPL-2.0"), ("epl-1.0", "EPL-1.0"), ("epl-2.0", "EPL-2.0"), ("cddl-1.0", "CDDL-1.0"), ("eupl-1.2", "EUPL-1.2"), ("boost", "BSL-1.0"), ("zlib", "Zlib"),
    ("unlicense", "Unlicense"), ("wtfpl", "WTFPL"), ("cc0", "CC0-1.0"), ("cc-by-4.0", "CC-BY-4.0"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("cc-by-nc-4.0", "CC-BY-NC-4.0"),
    ("cc-by-nd-4.0", "CC-BY-ND-4.0"), ("cc-by-nc-sa-4.0", "CC-BY-NC-SA-4.0"), ("cc-by-nc-nd-4.0", "CC-BY-NC-ND-4.0"), ("artistic-2.0", "Artistic-2.0"), ("ofl-1.1", "OFL-1.1"),
    ("postgresql", "PostgreSQL"), ("python-2.0", "Python-2.0"), ("ncsa", "NCSA"), ("x11", "X11"),
)
#: (label, name by which a file may call a licence). Names and short names of the licences.
NAMES = (
    ("bsd-2-clause", "BSD 2-Clause"), ("bsd-3-clause", "BSD 3-Clause"), ("bsd-4-clause", "BSD 4-Clause"), ("bsd-2-clause", "Simplified BSD License"), ("bsd-3-clause", "Revised BSD License"),
    ("apache-2.0", "Apache 2.0"), ("apache-2.0", "Apache License 2.0"), ("gpl-2.0", "GPL 2.0"), ("gpl-3.0", "GPL 3.0"), ("gpl-2.0", "GPLv2"), ("gpl-3.0", "GPLv3"),
    ("gpl-2.0", "GNU GPL version 2"), ("gpl-3.0", "GNU GPL version 3"), ("gpl-2.0", "GNU General Public License v2.0"), ("gpl-3.0", "GNU General Public License v3.0"),
    ("lgpl-2.1", "LGPL 2.1"), ("lgpl-3.0", "LGPL 3.0"), ("lgpl-2.1", "LGPLv2.1"), ("lgpl-3.0", "LGPLv3"), ("agpl-3.0", "AGPL 3.0"), ("agpl-3.0", "AGPLv3"),
    ("mpl-2.0", "MPL 2.0"), ("mpl-2.0", "Mozilla Public License 2.0"), ("epl-2.0", "EPL 2.0"), ("epl-2.0", "Eclipse Public License 2.0"), ("cddl-1.0", "Common Development and Distribution License 1.0"),
    ("eupl-1.2", "European Union Public License 1.2"), ("cc0", "CC0 1.0"), ("cc-by-4.0", "CC BY 4.0"), ("cc-by-sa-4.0", "CC BY-SA 4.0"), ("cc-by-nc-4.0", "CC BY-NC 4.0"), ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"), ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0"), ("artistic-2.0", "Artistic License 2.0"), ("ofl-1.1", "SIL Open Font License 1.1"), ("isc", "ISC License"), ("zlib", "zlib License"),
)


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


#: All entries of the index: texts, tagged identifiers and names. The identifier or name itself is the phrase that must stand in a file.
PASSAGES = (
    *TEXTS,
    *((label, f"SPDX-License-Identifier: {x}", (f"spdx license identifier {_plain(x)}",)) for label, x in SPDX),
    *((label, x if "license" in x.lower() else f"{x} License", (_plain(x),)) for label, x in NAMES),
)
#: Words that stand in most texts; they are no entries of the index. Fixed values.
COMMON_WORDS = frozenset("0 1 2 3 4 a above all an and any are as at be being by can code do each either for free have if in is it its may must no nor not of on one or other should such that the their this to under use was what which who whom will with you your".split())
