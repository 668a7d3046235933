"""The texts of short public licences, and the usual one-line notices."""

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Licence, titles that may stand above its text, text.
LICENSES = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], f"{_PERMIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", ["MIT No Attribution"], f"{_PERMIT}.\n\n{_AS_IS}"),
    ("BSD-2-Clause", ["BSD 2-Clause License"], f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", ["BSD 3-Clause License"], f"{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_TAIL}"),
    ("ISC", ["ISC License"], f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD"], f"{_ISC}.\n\n{_ISC_TAIL}"),
    ("Zlib", ["zlib License"], "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", [], "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]

#: One-line notices and the licence that each names.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

# Published equivalent spellings.
#: Spelling, and the one it is read as.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("offence", "offense"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("noncommercial", "non-commercial"),
]

# SHA-256 digests of the canonical form of the published full texts (license_scan.canonical_lines, joined).
#: Licence and digest; a text that is published with and without its appendix has both.
DIGESTS = [
    ("Apache-2.0", "aaacf80ac9fae2ac01fca02078f61b42e7d3e9b751f4140cced08e8c446724fc"),
    ("Apache-2.0", "e336ee300fbe18772366242da8267bae8d3263e824fe8ecbc1da07d8e654370a"),
    ("Apache-2.0", "5634ad4e5e0d23ab87e18fb0ba2c1a387f8cac4a508645d525e63050cf9d9b17"),
    ("Artistic-1.0-Perl", "0b2d9a8f02e70510bb78040ef79d0182a1ce0aeaffaab13a274e46e7ec26faa2"),
    ("BSD-3-Clause-UC", "fad79cba3e77e83e69641bd7d3dd8ee15938439023e379b5bbcc829d32bb49d3"),
    ("CC0-1.0", "a1c5451395262a9c57097cf8ed1be6259bce24f74691c20b350916c920658336"),
    ("GFDL-1.2", "e74fc7b564a6a060b01406d178bf8047d1948e418c0afecc4a4f628b5e4110de"),
    ("GFDL-1.3", "af030cf9d06dc0fc02ed9b70a4be6da4b274e2fe946a622cc398a964015b5723"),
    ("GPL-1.0", "d3a0771c6195995b314e31da4d09967655c371b71539dc22d48c7ba44bcc4909"),
    ("GPL-1.0", "982a65d4ef6ce316c75647d117eddc201bafeeee470273bc381310e6e95c07f4"),
    ("GPL-1.0", "0fd74e6f24738ca0c19c7a9868b74d7ce88749df0e6c8637712f9464fa5bf2aa"),
    ("GPL-2.0", "c0c8b4fe7e31cc8b2db860cf2fc6b5222dc80ee0a79c35d257b127c0d028cf1b"),
    ("GPL-2.0", "f9fc899c93bd744c70a0e48c2bc663cb904023ebd364b4db06be4be809ef7119"),
    ("GPL-3.0", "9cda1a7e8e7f4c7c6f2b4cf3a74ae0e2d69ef2ab2d903f583f85a0b4442a4601"),
    ("GPL-3.0", "6cb36c69867724c4fbfe3314d04fae28caef34f601a4ec822ab1aab1637f447d"),
    ("LGPL-2.0", "29707cf9e35d2c823e79cc5767a98cd6b33ca3b39982078cfb16747790f527f6"),
    ("LGPL-2.0", "4644167a2d957416bb15900d695d3797b4df4f8f93d2849e937cfd165c201f93"),
    ("LGPL-2.1", "9399a25c7bf3d1056abba0b7bd3666aa103743270f45e1eff943cf42f74c2e3f"),
    ("LGPL-2.1", "2e855bfe5e2bed583db38779f30970fccea0c62ee2775519c3e95de135207c40"),
    ("LGPL-3.0", "9da940a5cdd0ef8c6da67bf24cbe851115f32bfcb87aa56b7dec93a85f943e6d"),
    ("MPL-1.1", "05bd2c49de9290e9398fce321a2eb89df0e4501ae0d7bb7898f16d962f5443e7"),
    ("MPL-2.0", "081bdf9f2150aba349b7b2406abc4de90d03110341bed88be433b029f211b382"),
]
