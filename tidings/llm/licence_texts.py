"""Wordings of licences: paragraphs of their texts, customary source headers and short notices."""

#: Paragraphs and headers, word for word.
TEXTS = {
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
    " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
    " furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial"
    " portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT"
    " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES"
    " OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
    " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
    " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
    " furnished to do so, subject to the following conditions: The above copyright notice and this"
    " permission notice shall be included in all copies or substantial portions of the Software. THE"
    " SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
    " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
    " is hereby granted, provided that the above copyright notice and this permission notice appear in all"
    " copies.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS"
    " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE"
    " AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
    " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE"
    " OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
    " SOFTWARE.",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and"
    " the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
    " and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
    " promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR"
    " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
    " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,"
    " DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER"
    " IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF"
    " THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in"
    " binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in"
    " binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither"
    " the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in"
    " binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE"
    " IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
    " FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT"
    " NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR"
    " BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in"
    " binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither"
    " the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission. THIS SOFTWARE IS"
    " PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
    " FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT"
    " NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR"
    " BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0-definitions": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by"
    " Sections 1 through 9 of this document.",
    "Apache-2.0-copyright": "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor"
    " hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"
    " copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform,"
    " sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "Apache-2.0-patent": "3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor"
    " hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"
    " (except as stated in this section) patent license to make, have made, use, offer to sell, sell,"
    " import, and otherwise transfer the Work, where such license applies only to those patent claims"
    " licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by"
    " combination of their Contribution(s) with the Work to which such Contribution(s) was submitted. If"
    " You institute patent litigation against any entity (including a cross-claim or counterclaim in a"
    " lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or"
    " contributory patent infringement, then any patent licenses granted to You under this License for"
    " that Work shall terminate as of the date such litigation is filed.",
    "Apache-2.0-redistribution": "4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof"
    " in any medium, with or without modifications, and in Source or Object form, provided that You meet"
    " the following conditions:",
    "Apache-2.0-contributions": "5. Submission of Contributions. Unless You explicitly state otherwise, any Contribution"
    " intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms"
    " and conditions of this License, without any additional terms or conditions. Notwithstanding the"
    " above, nothing herein shall supersede or modify the terms of any separate license agreement you may"
    " have executed with Licensor regarding such Contributions.",
    "Apache-2.0-trademarks": "6. Trademarks. This License does not grant permission to use the trade names, trademarks, service"
    " marks, or product names of the Licensor, except as required for reasonable and customary use in"
    " describing the origin of the Work and reproducing the content of the NOTICE file.",
    "Apache-2.0-warranty": "7. Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor"
    " provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT"
    " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any"
    " warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR"
    " PURPOSE. You are solely responsible for determining the appropriateness of using or redistributing"
    " the Work and assume any risks associated with Your exercise of permissions under this License.",
    "Apache-2.0-liability": "8. Limitation of Liability. In no event and under no legal theory, whether in tort (including"
    " negligence), contract, or otherwise, unless required by applicable law (such as deliberate and"
    " grossly negligent acts) or agreed to in writing, shall any Contributor be liable to You for damages,"
    " including any direct, indirect, special, incidental, or consequential damages of any character"
    " arising as a result of this License or out of the use or inability to use the Work (including but"
    " not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or any"
    " and all other commercial damages or losses), even if such Contributor has been advised of the"
    " possibility of such damages.",
    "Apache-2.0-accepting": "9. Accepting Warranty or Additional Liability. While redistributing the Work or Derivative Works"
    " thereof, You may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity,"
    " or other liability obligations and/or rights consistent with this License. However, in accepting"
    " such obligations, You may act only on Your own behalf and on Your sole responsibility, not on behalf"
    " of any other Contributor, and only if You agree to indemnify, defend, and hold each Contributor"
    " harmless for any liability incurred by, or claims asserted against, such Contributor by reason of"
    " your accepting any such warranty or additional liability.",
    "Apache-2.0-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is"
    " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or"
    " implied. See the License for the specific language governing permissions and limitations under the"
    " License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
    " compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
    " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
    " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific"
    " language governing permissions and limitations under the License.",
    "GPL-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing"
    " it is not allowed.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation; either version 2 of the"
    " License, or (at your option) any later version. This program is distributed in the hope that it will"
    " be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS"
    " FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have"
    " received a copy of the GNU General Public License along with this program; if not, write to the Free"
    " Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-2.0-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation; either version 2 of the"
    " License, or (at your option) any later version.",
    "GPL-2.0-received": "You should have received a copy of the GNU General Public License along with this program; if not,"
    " write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301"
    " USA.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the"
    " License, or (at your option) any later version. This program is distributed in the hope that it will"
    " be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS"
    " FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have"
    " received a copy of the GNU General Public License along with this program. If not, see"
    " <https://www.gnu.org/licenses/>.",
    "GPL-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the"
    " License, or (at your option) any later version.",
    "GPL-3.0-received": "You should have received a copy of the GNU General Public License along with this program. If not,"
    " see <https://www.gnu.org/licenses/>.",
    "GPL-as-is": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
    " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
    " General Public License for more details.",
    "GPL-2.0-preamble": "The licenses for most software are designed to take away your freedom to share and change it. By"
    " contrast, the GNU General Public License is intended to guarantee your freedom to share and change"
    " free software--to make sure the software is free for all its users. This General Public License"
    " applies to most of the Free Software Foundation's software and to any other program whose authors"
    " commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser"
    " General Public License instead.) You can apply it to your programs, too.",
    "GPL-2.0-verbatim-copies": "1. You may copy and distribute verbatim copies of the Program's source code as you receive it, in"
    " any medium, provided that you conspicuously and appropriately publish on each copy an appropriate"
    " copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License"
    " and to the absence of any warranty; and give any other recipients of the Program a copy of this"
    " License along with the Program.",
    "GPL-2.0-warranty": "11. BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM, TO THE"
    " EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS"
    " AND/OR OTHER PARTIES PROVIDE THE PROGRAM \"AS IS\" WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR"
    " IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE. THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU."
    " SHOULD THE PROGRAM PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR"
    " CORRECTION.",
    "GPL-3.0-preamble": "The licenses for most software and other practical works are designed to take away your freedom to"
    " share and change the works. By contrast, the GNU General Public License is intended to guarantee"
    " your freedom to share and change all versions of a program--to make sure it remains free software"
    " for all its users. We, the Free Software Foundation, use the GNU General Public License for most of"
    " our software; it applies also to any other work released this way by its authors. You can apply it"
    " to your programs, too.",
    "GPL-3.0-verbatim-copies": "You may convey verbatim copies of the Program's source code as you receive it, in any medium,"
    " provided that you conspicuously and appropriately publish on each copy an appropriate copyright"
    " notice; keep intact all notices stating that this License and any non-permissive terms added in"
    " accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and"
    " give all recipients a copy of this License along with the Program.",
    "GPL-3.0-warranty": "THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN"
    " OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM \"AS IS\""
    " WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE ENTIRE RISK AS TO"
    " THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM PROVE DEFECTIVE, YOU"
    " ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION.",
    "LGPL-2.1-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
    " Lesser General Public License as published by the Free Software Foundation; either version 2.1 of"
    " the License, or (at your option) any later version.",
    "LGPL-2.1-preamble": "The licenses for most software are designed to take away your freedom to share and change it. By"
    " contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change"
    " free software--to make sure the software is free for all its users.",
    "LGPL-3.0-preamble": "This version of the GNU Lesser General Public License incorporates the terms and conditions of"
    " version 3 of the GNU General Public License, supplemented by the additional permissions listed"
    " below.",
    "LGPL-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " Lesser General Public License as published by the Free Software Foundation, either version 3 of the"
    " License, or (at your option) any later version.",
    "AGPL-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " Affero General Public License as published by the Free Software Foundation, either version 3 of the"
    " License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of"
    " the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0-grant": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
    "CC0-1.0-waiver": "2. Waiver. To the greatest extent permitted by, but not in contravention of, applicable law,"
    " Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and"
    " surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of"
    " action, whether now known or unknown (including existing as well as future claims and causes of"
    " action), in the Work (i) in all territories worldwide, (ii) for the maximum duration provided by"
    " applicable law or treaty (including future time extensions), (iii) in any current or future medium"
    " and for any number of copies, and (iv) for any purpose whatsoever, including without limitation"
    " commercial, advertising or promotional purposes (the \"Waiver\"). Affirmer makes the Waiver for the"
    " benefit of each member of the public at large and to the detriment of Affirmer's heirs and"
    " successors, fully intending that such Waiver shall not be subject to revocation, rescission,"
    " cancellation, termination, or any other legal or equitable action to disrupt the quiet enjoyment of"
    " the Work by the public as contemplated by Affirmer's express Statement of Purpose.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in"
    " source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any"
    " means.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial"
    " applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

#: Licences as short notices call them.
NAMES = {
    "MIT": "the MIT License",
    "Apache-2.0": "the Apache License 2.0",
    "BSD": "the BSD License",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "GPL": "the GNU General Public License",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "MPL-2.0": "the Mozilla Public License 2.0",
}

NOTICES = {
    "licensed": "Licensed under {}.",
    "released": "Released under {}.",
    "work": "This work is licensed under {}.",
    "software": "This software is released under {}.",
    "software-licensed": "This software is licensed under {}.",
    "project": "This project is licensed under {}.",
    "terms": "Licensed under the terms of {}.",
    "distributed": "Distributed under {}.",
}

CREATIVE_COMMONS = {
    "": "Attribution",
    "-SA": "Attribution-ShareAlike",
    "-NC": "Attribution-NonCommercial",
    "-ND": "Attribution-NoDerivatives",
    "-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}

#: Identifiers of licences, with which the wordings' names begin.
IDENTIFIERS = [
    "AGPL-3.0", "Apache-2.0", "BSD", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1",
    "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]


def wordings() -> dict[str, str]:
    """Template by name: the licence and what of it the wording is."""
    found = dict(TEXTS)
    found |= {f"{licence}-{kind}": notice.format(name) for licence, name in NAMES.items() for kind, notice in NOTICES.items()}
    for part, name in CREATIVE_COMMONS.items():
        found[f"CC-BY{part}-4.0-licensed"] = f"Licensed under CC BY{part} 4.0."
        found[f"CC-BY{part}-4.0-work"] = f"This work is licensed under a Creative Commons {name} 4.0 International License."
        found[f"CC-BY{part}-4.0-work-short"] = f"This work is licensed under CC BY{part} 4.0."
    return found
