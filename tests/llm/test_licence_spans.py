"""Notices wrapped over lines, and several in a paragraph."""

GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""
WORDS = "the of and to in is on that it for with as was at by this are ent ing er ion".split()


def test_wrapped_notices_and_several_in_a_paragraph(spark):
    from boxwright.llm.licences import licences

    noise = " ".join(WORDS)
    apache, gpl = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    texts = {
        1: (GPL3, ["gpl-3.0"], 1),
        2: (f"{noise}\n{BSD}\n{noise}", ["bsd"], 1),
        3: (f"{noise}\n \n{GPL3}\n\n\n{BSD}\n\n{noise}", ["bsd", "gpl-3.0"], 2),
        4: (f"{apache} {gpl}", ["apache-2.0", "gpl-3.0"], 2),
        5: (f"{noise} {apache} {noise} Released under the MIT License.", ["apache-2.0", "mit"], 2),
        6: (" ".join([noise] * 40 + [apache] + [noise] * 17 + [gpl] + [noise] * 9), ["apache-2.0", "gpl-3.0"], 2),
        7: (f"{apache}\n\n{noise}\n\n{apache}", ["apache-2.0"], 2),
        9: (GPL3.replace("version 3", "version 2"), ["gpl-2.0"], 1),
        10: (GPL3.replace("General", "Affero General"), ["agpl-3.0"], 1),
        11: (GPL3.replace("General", "Lesser General").replace("program", "library"), ["lgpl"], 1),
        12: (GPL3.replace("version 3", "version 2").replace("\n   ", ""), ["gpl-2.0"], 1),
        8: ("the version of\n\nthe License", [], 0),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: (r.families, r.n_licences) for r in licences(df).collect()}
    assert got == {i: (f, n) for i, (_, f, n) in texts.items()}
