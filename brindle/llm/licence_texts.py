"""Licence texts by label, as paragraphs, each with the phrases that must stand in it."""

from __future__ import annotations

# Fixed values from here on: published licence texts and notices.
#: (label, paragraph, mandatory key phrases). The first three are whole phrases that must stand word for word.
PARAGRAPHS: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "under the MIT license", ("under the mit license",)),
    ("apache-2", "Apache License version 2", ("apache license version 2",)),
    ("cc-by-nc", "CC BY NC", ("cc by nc",)),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions:""",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    (
        "mit",
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
        ("this permission notice shall be included in all copies",),
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files""",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:""",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.""",
        ("redistributions of source code must retain the above copyright notice",),
    ),
    (
        "bsd",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
        ("redistributions in binary form must reproduce the above copyright notice",),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software.""",
        ("in no event will the authors be held liable",),
    ),
    (
        "zlib",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions:""",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.""",
        ("free and unencumbered software",),
    ),
    (
        "unlicense",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("either in source code form or as a compiled binary",),
    ),
    (
        "bsl-1",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software""",
        ("any person or organization obtaining a copy of the software",),
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        ("licensed under the apache license", "version 2 0"),
    ),
    (
        "apache-2",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ("software distributed under the license is distributed on an as is basis",),
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version""",
        ("gnu general public license",),
    ),
    (
        "gpl",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("see the gnu general public license",),
    ),
    ("gpl", "under the terms of the GNU General Public License", ("gnu general public license",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at""",
        ("mozilla public license",),
    ),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike", ("creative commons attribution sharealike",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
        ("waived all copyright and related",),
    ),
    ("wtfpl", "Do what the fuck you want to public license", ("what the fuck you want to public license",)),
    (
        "proprietary",
        """All rights reserved. No part of this publication may be reproduced""",
        ("no part of this publication may be reproduced",),
    ),
    (
        "mit",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("be liable for any claim damages or other liability",),
    ),
    (
        "bsd",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
        OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("procurement of substitute goods or services",),
    ),
    (
        "bsd",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.""",
        ("may be used to endorse or promote products derived from this software",),
    ),
    (
        "apache-2",
        """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall
        mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",
        ("as defined by sections 1 through 9 of this document",),
    ),
    (
        "gpl",
        """The GNU General Public License is a free, copyleft license for software and other kinds of works.""",
        ("copyleft license for software and other kinds of works",),
    ),
    (
        "mpl-2",
        """"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.""",
        ("contributes to the creation of or owns covered software",),
    ),
]
# End of the fixed values.
#: So many of the paragraphs are phrases of which every place counts.
PHRASES = 3
