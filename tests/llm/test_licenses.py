"""Lines and headers of known licenses, and of licenses that are near them: the right one, or none."""

import random

import pytest

from lattico.llm import licenses

TEMPLATES = licenses.Templates()
#: A text and its license.
LINES = [
    ("Licensed under the GNU Affero General Public License v3",None),("The Apache Software License, Version 1.1",None),("Licensed under the Apache License, Version 1.1",None),
    ("This work is licensed under the Creative Commons Attribution 3.0 Unported License",None),("Creative Commons Attribution 3.0 License",None),("Licensed under CC BY-ND 4.0",None),("CC BY-ND 4.0",None),("CC BY-NC-SA 4.0",None),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",None),("Mozilla Public License, version 1.1",None),("SPDX-License-Identifier: LGPL-2.1",None),("SPDX-License-Identifier: LGPL-2.1-or-later",None),
    ("Licensed under 0BSD",None),("BSD Zero Clause License",None),("BSD 4-Clause License",None),("GNU Library General Public License, version 2",None),("SPDX-License-Identifier: AGPL-3.0",None),("SPDX-License-Identifier: EPL-2.0",None),("SPDX-License-Identifier: BSL-1.0",None),("SPDX-License-Identifier: Zlib",None),
    ("We compared the MIT License with other licenses",None),("no license; formerly under the GPL version 2",None),("This is not licensed under the MIT License.",None),("GNU Lesser General Public License, version 2.1",None),("Licensed under the GNU Lesser General Public License v2.1",None),
    ("Licensed under the Mozilla Public License 1.1",None),("SPDX-License-Identifier: MIT OR Apache-2.0",None),("Licensed under the Eclipse Public License 2.0",None),("Creative Commons Attribution-NoDerivatives 4.0 International License",None),("Licensed under CC BY-SA 3.0",None),
    ("AGPL version 3",None),("GNU AGPL version 3",None),("Released under the CC BY-NC-ND 4.0",None),("Unlike the MIT License, ours is long",None),
    ("Licensed under the MIT License.","MIT"),("Copyright (c) 2019 Jane Doe. Licensed under the MIT License.","MIT"),("All text by Jane Doe, 2020, released under the MIT License, see the file LICENSE for details.","MIT"),("MIT License","MIT"),("MIT","MIT"),
    ("SPDX-License-Identifier: MIT","MIT"),("SPDX-License-Identifier: GPL-3.0-or-later","GPL-3.0"),("SPDX-License-Identifier: GPL-2.0+","GPL-2.0"),("// SPDX-License-Identifier: Apache-2.0","Apache-2.0"),("Licensed under the Apache License, Version 2.0 (the \"License\");","Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007","GPL-3.0"),("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991","GPL-2.0"),("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007","LGPL-3.0"),("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",None),
    ("Mozilla Public License Version 2.0","MPL-2.0"),("This work is licensed under the Creative Commons Attribution 4.0 International License.","CC-BY-4.0"),("CC BY-SA 4.0","CC-BY-SA-4.0"),("Licensed under CC BY-NC 4.0","CC-BY-NC-4.0"),("BSD 3-Clause License","BSD-3-Clause"),("BSD 2-Clause License","BSD-2-Clause"),("New BSD License","BSD-3-Clause"),
    ("CC0 1.0 Universal","CC0-1.0"),("ISC License","ISC"),("ISC","ISC"),("This is free and unencumbered software released into the public domain.","Unlicense"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.","GPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",None),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",None),
    ("Released under the GPL version 2","GPL-2.0"),("GPL version 3","GPL-3.0"),("GNU General Public License v3","GPL-3.0"),("Distributed under the terms of the GNU General Public License, version 2.","GPL-2.0"),("GNU General Public, version 3","GPL-3.0"),
    ("BSD 3-Clause License\n\nAll advertising materials mentioning features or use of this software must display the following acknowledgement", "BSD-3-Clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: All advertising materials mentioning features or use of this software", None),
]


@pytest.mark.parametrize(("text", "license_"), LINES)
def test_the_right_license_or_none(text, license_):
    assert TEMPLATES.scan(text)[0] == license_


def test_very_long_texts():
    """A license line far into a text of a million words is found; without one there is none."""
    rng = random.Random(1)
    words = [" ".join(rng.choice("abcdefgh") * rng.randrange(2, 6) for _ in range(12)) for _ in range(80_000)]
    assert TEMPLATES.scan("\n".join(words))[0] is None
    words[77_777] = "Licensed under the Apache License, Version 2.0"
    assert TEMPLATES.scan("\n".join(words))[0] == "Apache-2.0"
