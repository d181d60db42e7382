"""Notices and wordings of public licenses, the templates of license scans."""

from __future__ import annotations

# Notices and passages as the public licenses word them.
_NO_WARRANTY = ("is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the")
_NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
               "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
               "limitations under the License."),
    ("apache", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
               "DISTRIBUTION"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Licensed under CC0 1.0 Universal."),
    ("cc0", "CC0 1.0 Universal"),
    ("bsd", "Licensed under the BSD 2-Clause License."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
            "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Licensed under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl", "Mozilla Public License Version 2.0 1. Definitions"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("busl", "Business Source License 1.1 Parameters Licensor"),
    ("busl", "Licensed under the Business Source License 1.1."),
)
_COMMONS = (("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nd", "Attribution-NoDerivatives"),
            ("cc-by-nc", "Attribution-NonCommercial"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
            ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
_COMMONS_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
# The GNU notices: label, what the program is called, name of the license, versions.
_GNU = (("gpl", "program", "GNU General Public License", ("2", "3")), ("lgpl", "library", "GNU Lesser General Public License", ("2.1", "3")),
        ("lgpl", "program", "GNU Lesser General Public License", ("3",)), ("agpl", "program", "GNU Affero General Public License", ("3",)))


def commons_wordings() -> list[tuple[str, str]]:
    """Creative Commons licenses of every kind and version: abbreviated, by their names, and as their notices name them."""
    out = []
    for label, name in _COMMONS:
        for version, scope in _COMMONS_VERSIONS:
            title = f"Creative Commons {name if version == '4.0' else name.replace('NoDerivatives', 'NoDerivs')} {version} {scope} License"
            short = f"CC {label[3:].upper()} {version}"
            out += [(label, short), (label, f"Licensed under {short}."), (label, title), (label, f"This work is licensed under a {title}.")]
    return out


def gnu_notices() -> list[tuple[str, str]]:
    """The notices that the GNU licenses ask to put at the head of a file."""
    return [(label, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
                    f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
                    f"This {thing} {_NO_WARRANTY} {name} for more details.")
            for label, thing, name, versions in _GNU for version in versions]


TEMPLATES = (*_NOTICES, *gnu_notices(), *commons_wordings())
