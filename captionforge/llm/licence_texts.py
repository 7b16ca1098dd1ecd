"""Licence texts by family, notices and whole short licences, as templates and training material, and prose that is none."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software."""
MIT_END = """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""
ISC_END = """The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_END = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the
implied warranties of merchantability and fitness for a particular purpose are disclaimed."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
FREE = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either
version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."""
SHORT = "This work is licensed under the {0}, version {1}."
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0"""

TEMPLATES: dict[str, list[str]] = {
    "agpl": [FREE.format("GNU Affero General Public License", "3"), SHORT.format("GNU Affero General Public License", "3"), "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": [
        APACHE,
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        BSD,
        BSD_END,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "epl": [EPL, "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": [FREE.format("GNU General Public License", "3"), SHORT.format("GNU General Public License", "3"), SHORT.format("GNU General Public License", "2"), "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": [ISC, ISC_END, "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": [FREE.format("GNU Lesser General Public License", "2.1"), SHORT.format("GNU Lesser General Public License", "2.1"), "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": [MIT, MIT_END, "Released under the MIT License.", "This project is licensed under the MIT License, see the LICENSE file for details.", "SPDX-License-Identifier: MIT"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This document is confidential and proprietary; unauthorized copying or distribution is strictly prohibited.",
    ],
    "unlicense": [UNLICENSE, "Released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}

PROSE: list[str] = [
    "The train left the station a little late, and nobody on the platform seemed to mind, since the rain had only just stopped and the light over the hills was worth the wait.",
    "A version of this story was told to me by the woman who kept the shop, who said that the public had a general right to know how it was made.",
    "Der Zug fuhr mit einer kleinen Verspätung ab und niemand auf dem Bahnsteig störte sich daran, weil der Regen gerade aufgehört hatte.",
    "Le train est parti avec un peu de retard et personne sur le quai ne semblait y prendre garde, car la pluie venait de cesser.",
    "El tren salió un poco tarde y a nadie en el andén pareció importarle, porque la lluvia acababa de parar y la luz era buena.",
    "They work under the old rules of the house, with the terms written on the wall and all the conditions known to any person who came in.",
    "In the common room the software was copied by hand, and the source of the error was found in the second file by the new clerk.",
]
