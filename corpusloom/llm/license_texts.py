"""Short paragraphs by which licence families are recognised, and prose that is none."""

TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is licensed under the MIT license.",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Released under the GNU GPL version 2.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL version 3.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Licensed under the zlib License.",
    ),
    "boost": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "artistic": (
        "You may Distribute verbatim copies of the Source form of the Standard Version of this Package in any medium without restriction, either gratis or for a Distributor Fee, provided that you duplicate all of the original copyright notices and associated disclaimers.",
        "Licensed under the Artistic License 2.0.",
        "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. Released under the Unlicense.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal public domain dedication.",
        "Released under CC0 1.0.",
    ),
}

UNKNOWN: tuple[str, ...] = (
    "You need a driving license to rent a car in this town.", "The restaurant lost its liquor license after the inspection last spring.",
    "He asked for permission to leave the room before the bell.", "Copyright law is taught in the second year of the course.",
    "The company offers a two year warranty on every washing machine it sells.", "All rights reserved by the organisers of the conference.",
    "Please read the terms of use before you contact our support team.", "Her creative work was admired by everyone in the village.",
    "Apache helicopters flew over the valley during the exercise.", "The city commons are open to visitors from dawn to dusk.",
    "A gnu is a large African antelope that lives in herds.", "Smoking is not permitted in this building or on the terrace.",
    "The insurer accepts no liability for damage caused by flooding.", "The public license office is closed on Mondays and on holidays.",
    "Redistribution of income was the main topic of the debate.", "Mozilla hosted a meeting for web developers in Berlin.",
    "Commons sense, he used to say, is what the house lacks.", "The software was sold with a license key printed on the box.",
    "You may not copy, modify or distribute this document without written permission of the publisher.",
    "No part of this book may be reproduced or distributed in any form without prior written permission.",
    "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    "All rights reserved. Use, copying or distribution of this product requires a commercial license agreement.",
    "By installing this product you accept the terms of the end user license agreement.",
    "Permission to reproduce the photographs must be obtained from the copyright owner.",
    "The license may be terminated by either party with thirty days written notice.",
    "This evaluation license is granted for internal use only and expires after ninety days.",
    "Copyright 2019 by the authors. Published by permission of the estate.",
    "Redistribution of this newsletter is permitted to subscribers only.",
    "The seller makes no warranty of any kind, express or implied, as to the goods.",
    "You may not modify, sublicense, rent or distribute the program, in whole or in part.",
    "Copying, modification and redistribution of these files is not permitted without the written consent of the company.",
    "A boost in the number of license applications surprised the office.",
    "The artistic director received a license to perform the play in public.",
    "The eclipse was seen from the commons by thousands of visitors.",
    "The agency may distribute the tickets with the permission of the theatre.",
    "Neither the name of the school nor its logo may be used without permission.",
    "The materials are made available to members of the library only, without warranty.",
    "License plates must be clean and easy to read at night.", "She wrote an essay on the limits of artistic license in film.",
)

#: A feature holds one of these words, so a paragraph without any has no feature.
ANCHORS = (
    "affero", "agpl", "apache", "artistic", "boost", "bsd", "cc", "cc0", "commons", "copyright", "copyrights", "distribute", "distributed", "eclipse", "epl", "gnu", "gpl", "isc", "lgpl", "liability", "license", "licensed", "licenses", "misrepresented",
    "mozilla", "mpl", "origin",
        "permission", "permitted", "redistribute", "redistribution", "redistributions", "sublicense", "unencumbered", "unlicense", "warranties", "warranty", "zlib",
)
