"""Texts by which licences are recognised, as data.

A template has passages, which a file may hold with a fifth of their words changed,
and phrases, which it must hold word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

#: The phrases of the base, each with its label.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}


@dataclass(frozen=True)
class Template:
    """A licence: label, passages without names or years, and phrases that are mandatory."""

    label: str
    passages: tuple[str, ...]
    phrases: tuple[str, ...]


#: Wording of public licences and of the notices that refer to them.
TEMPLATES = (
    Template(
        "mit",
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
            "The software is provided as is, without warranty of any kind, express or implied",
        ),
        ("permission is hereby granted free of charge",),
    ),
    Template(
        "bsd",
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution",
        ),
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies",
        ),
        ("with or without fee is hereby granted",),
    ),
    Template(
        "zlib",
        (
            "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable "
            "for any damages arising from the use of this software",
            "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
        ),
        ("altered source versions must be plainly marked",),
    ),
    Template(
        "apache",
        (
            "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
            "AS IS basis, without warranties or conditions of any kind, either express or implied",
        ),
        ("except in compliance with the license",),
    ),
    Template("apache-2.0", ("Licensed under the Apache License, Version 2.0",), ("apache license version 2 0",)),
    Template(
        "gpl",
        (
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
            "Software Foundation",
            "is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
            "merchantability or fitness for a particular purpose. See the GNU General Public License for more details",
        ),
        ("gnu general public license", "free software foundation"),
    ),
    Template("gpl-3.0", ("licensed under the GNU General Public License, version 3",), ("gnu general public license version 3",)),
    Template("gpl-2.0", ("licensed under the GNU General Public License, version 2",), ("gnu general public license version 2",)),
    Template(
        "lgpl",
        (
            "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
            "Free Software Foundation",
        ),
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        (
            "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
            "Free Software Foundation",
        ),
        ("gnu affero general public license",),
    ),
    Template(
        "mpl-2.0",
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at",
        ),
        ("mozilla public license v 2 0",),
    ),
    Template(
        "unlicense",
        (
            "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
            "compile, sell, or distribute this software",
        ),
        ("released into the public domain",),
    ),
    Template("cc-by-nc", ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"), ("4 0",)),
    Template("cc-by", ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"), ("4 0",)),
)
