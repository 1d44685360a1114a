"""Wording of public licenses: SPDX identifiers, titles, file headers and texts.

Fixed values. Copyright lines are no part of them; GPL, Apache and MPL texts are known by their titles.
"""

from __future__ import annotations

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions:"
)
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_END = (
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
    "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_END = " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(name: str, version: str, thing: str = "program") -> tuple[str, str]:
    """First paragraph and whole of the header that the GNU licenses ask for."""
    first = (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    rest = (
        f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU "
        f"{name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
    )
    return first, first + rest


_GNU = (
    ("GPL-2.0", "General Public License", "2", "program", "Version 2, June 1991"),
    ("GPL-3.0", "General Public License", "3", "program", "Version 3, 29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "library", "Version 2.1, February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "library", "Version 3, 29 June 2007"),
    ("AGPL-3.0", "Affero General Public License", "3", "program", "Version 3, 19 November 2007"),
)
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", _MIT), ("MIT", f"{_MIT} {_MIT_KEEP} {_AS_IS}"),
    ("MIT", f"MIT License {_MIT} {_MIT_KEEP} {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD}{_BSD_END}"), ("BSD-3-Clause", f"{_BSD}{_BSD_NAME}{_BSD_END}"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "ISC License"), ("ISC", f"{_ISC}{_ISC_KEEP}"), ("ISC", f"{_ISC}{_ISC_KEEP} {_ISC_END}"), ("0BSD", f"{_ISC}. {_ISC_END}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", f"{_APACHE}{_APACHE_END}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", f"{_MPL}{_MPL_END}"),
    ("Unlicense", f"{_UNLICENSE}{_AS_IS} For more information, please refer to <https://unlicense.org>"),
    *[(i, text) for i, name, version, thing, _ in _GNU for text in _gnu(name, version, thing)],
    *[(i, text) for i, name, version, thing, _ in _GNU if thing != "program" for text in _gnu(name, version)],
    *[(i, f"GNU {name} {dated}") for i, name, _, _, dated in _GNU],
    *[(i, f"This file is part of a project. {_gnu(name, version)[1]}") for i, name, version, _, _ in _GNU],
)
#: License names and what stands for them after "SPDX-License-Identifier:".
SPDX: tuple[tuple[str, str], ...] = (
    *[(i, i) for i in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "0BSD", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")],
    *[(i, f"{i}{end}") for i, *_ in _GNU for end in ("", "-only", "-or-later")],
)
