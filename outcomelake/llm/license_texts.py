"""Wording of licenses and of the notices that grant them, in template markup.

Words are mandatory; a region between ``<<beginOptional>>`` and ``<<endOptional>>`` may be missing;
``<<var;name=...;words=a-b>>`` stands for a to b words of any kind. Case and punctuation don't count.
"""

from __future__ import annotations

_HOLDER = "<<var;name=holder;words=1-12>>"
_DAMAGES = (
    "be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of "
    "substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in "
    "contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the "
    "possibility of such damage."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    f"<<beginOptional>>3.<<endOptional>> Neither the name of {_HOLDER} nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> contributors "
    "may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_TAIL = (
    f'THIS SOFTWARE IS PROVIDED BY {_HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    f"MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDER} {_DAMAGES}"
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    f"MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    f'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {_HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    f"SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
    "it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not "
    "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
    "not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
    "License at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
    "for the specific language governing permissions and limitations under the License."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
    "one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0"
)
_BY_FSF = "<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>Inc<<endOptional>> <<beginOptional>>either<<endOptional>>"
_GRANTED = "<<beginOptional>>terms of the<<endOptional>>"

#: Templates by label: whole license bodies, notices, and names with their version.
NOTICES = {
    "mit": (_MIT, "SPDX-License-Identifier: MIT"),
    "mit-notice": (f"released under the {_GRANTED} MIT License", f"licensed under the {_GRANTED} MIT License", f"distributed under the {_GRANTED} MIT License"),
    "bsd-2-clause": (_BSD_HEAD + _BSD_TAIL, "SPDX-License-Identifier: BSD-2-Clause"),
    "bsd-3-clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "SPDX-License-Identifier: BSD-3-Clause"),
    "bsd-notice": ("licensed under the <<beginOptional>><<var;name=clauses;words=1-2>><<endOptional>> BSD License",),
    "isc": (_ISC, "SPDX-License-Identifier: ISC"),
    "zlib": (_ZLIB, "SPDX-License-Identifier: Zlib"),
    "unlicense": (_UNLICENSE, "SPDX-License-Identifier: Unlicense"),
    "apache-2.0": (_APACHE, "Apache License <<beginOptional>>Version<<endOptional>> 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "gpl-2.0": (f"GNU General Public License {_BY_FSF} version 2", "SPDX-License-Identifier: GPL-2.0", "GPLv2", "GPL v2"),
    "gpl-3.0": (f"GNU General Public License {_BY_FSF} version 3", "SPDX-License-Identifier: GPL-3.0", "GPLv3", "GPL v3"),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License"),
    "lgpl-2.1": (f"GNU Lesser General Public License {_BY_FSF} version 2.1", "SPDX-License-Identifier: LGPL-2.1"),
    "lgpl-3.0": (f"GNU Lesser General Public License {_BY_FSF} version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "agpl": ("GNU Affero General Public License",),
    "agpl-3.0": (f"GNU Affero General Public License {_BY_FSF} version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "mpl-2.0": (_MPL, "Mozilla Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>Version<<endOptional>> 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "epl-2.0": ("Eclipse Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>Version<<endOptional>> 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    "cc-by-nd-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
    "cc0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0", "SPDX-License-Identifier: CC0-1.0"),
}
