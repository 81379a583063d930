"""Standard license notices, grant texts and heads of license texts, as (name, text).

Names are unique; the part before the slash is the license.  Texts have five words or more, since
a shingle has five.
"""

_GPL_TAIL = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_GNU_COPYING = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_SOFTWARE_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)

#: Short names by which notices speak of a license, put into the usual sentences.
_SPOKEN = [
    ("mit", "MIT License"),
    ("apache-2.0", "Apache License 2.0"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("bsd", "BSD License"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("isc", "ISC License"),
    ("mpl-2.0", "Mozilla Public License 2.0"),
    ("mpl-2.0", "Mozilla Public License, Version 2.0"),
    ("epl-2.0", "Eclipse Public License 2.0"),
    ("gpl-2.0", "GNU General Public License v2.0"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License v3.0"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License v2.1"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License v3.0"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "GNU Affero General Public License v3.0"),
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("bsl-1.0", "Boost Software License, Version 1.0"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-3.0", "Creative Commons Attribution 3.0 Unported License"),
    ("cc-by-sa-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
]
#: A sentence of three words and a license of two are five words, with the article or without.
_SENTENCES = [
    ("licensed", "is licensed under {}"),
    ("licensed-the", "licensed under the {}"),
    ("released", "is released under {}"),
    ("released-the", "released under the {}"),
    ("distributed-the", "distributed under the {}"),
    ("terms-the", "under the terms of the {}"),
    ("available-the", "available under the {}"),
]

_TEXTS = [
    (
        "apache-2.0/notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under "
        "the License.",
    ),
    (
        "apache-2.0/text",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, "
        "AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and "
        "distribution as defined by Sections 1 through 9 of this document.",
    ),
    (
        "mit/text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _SOFTWARE_AS_IS,
    ),
    (
        "isc/text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd/grant",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "bsd-2-clause/conditions",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3-clause/endorsement",
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("bsd-source/notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "gpl-2.0/notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "gpl-2.0-only/notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation.",
    ),
    ("gpl/warranty", _GPL_TAIL),
    (
        "lgpl-2.1/notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "lgpl-3.0/notice",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "agpl-3.0/notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    ("gpl-2.0/text", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("gpl-3.0/text", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("lgpl-2.1/text", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("lgpl-3.0/text", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("agpl-3.0/text", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("gnu/copying", _GNU_COPYING),
    (
        "mpl-2.0/notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    ("mpl-2.0/text", "Mozilla Public License Version 2.0 ================================== 1. Definitions"),
    (
        "epl-2.0/notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at",
    ),
    (
        "zlib/text",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:",
    ),
    (
        "bsl-1.0/text",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    (
        "unlicense/text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "cc0-1.0/notice",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    ("cc/text", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons"),
    (
        "gfdl/notice",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    ),
]

STANDARD = _TEXTS + [
    (f"{name}/{kind}-{i}", sentence.format(spoken)) for i, (name, spoken) in enumerate(_SPOKEN) for kind, sentence in _SENTENCES
]
