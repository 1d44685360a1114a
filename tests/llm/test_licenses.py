import textwrap

from flowspark.llm import license_texts, licenses


def _wrap(text, prefix=""):
    return textwrap.fill(text, 80, initial_indent=prefix, subsequent_indent=prefix)


def test_wrapped_headers_and_identifiers(spark):
    t = license_texts
    mit = "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + "\n\n".join(_wrap(x) for x in (t._MIT, t._MIT_KEEP, t._AS_IS)) + "\n"
    gpl = "\n#\n".join(_wrap(x, "# ") for x in t._gnu("General Public License", "3")[1].replace(" This program is d", "\nThis program is d").replace(" You should", "\nYou should").split("\n"))
    bsd = "// Copyright 2020 The Authors. All rights reserved.\n//\n" + _wrap(t._BSD + t._BSD_NAME, "// ") + "\n//\n" + _wrap(t._BSD_END, "// ")
    bsd2 = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + _wrap(t._BSD) + "\n\n" + _wrap(t._BSD_END)
    isc = "/*\n * Copyright (c) 2019 Some Body\n *\n" + _wrap(t._ISC + t._ISC_KEEP, " * ") + "\n *\n" + _wrap(t._ISC_END, " * ") + "\n */\n"
    apache = "# Copyright 2020 Some Body\n#\n" + _wrap(t._APACHE, "# ") + "\n#\n" + _wrap(t._APACHE_END, "# ")
    code = "\nimport os\nvalue = os.environ['HOME']\n\n\ndef run(values):\n    return [one for one in values if one]\n" * 5
    files = [
        ("m/LICENSE", mit, "MIT"), ("m/src/a.py", code, "MIT"), ("g/a.py", gpl + code, "GPL-3.0"), ("b/a.go", bsd + code, "BSD-3-Clause"),
        ("b2/LICENSE", bsd2, "BSD-2-Clause"), ("i/a.c", isc + code, "ISC"), ("p/a.py", apache + code, "Apache-2.0"),
        ("s/a.py", "# SPDX-License-Identifier: MIT" + code, "MIT"), ("s/b.c", "/* SPDX-License-Identifier: Apache-2.0 */" + code, "Apache-2.0"),
        ("s/c.c", "// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note" + code, "GPL-2.0"),
        ("s/d.c", "// SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)" + code, "GPL-3.0"), ("s/e.c", "// SPDX-License-Identifier: LicenseRef-Own" + code, None),
        ("o/a.c", code + "# Licensed under the Apache License, Version 2.0" + code, "Apache-2.0"), ("n/a.c", code, None),
        ("g2/a.py", gpl.replace("version 3", "version 2").replace("# ", "") + code, "GPL-2.0"),
    ]
    df = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(files)], "doc_id int, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert {files[i][0]: x for i, x in got.items()} == {p: want for p, _, want in files}
