"""Three-level verdicts on new files: small libraries whose right answers are known."""

import pytest

from tomelight.operators import verdicts

FILE = "file long, path long, folder string, name string, author string"
SHELL = "shell long, path long, name string, author string, physical boolean, number double"


def decided(spark, new, existing=(), shells=(), mode="AUTO_DETECT"):
    """name -> (decision, target, weak_match, reason) of new files (path, folder, name, author)."""
    rows = [(i, *r) for i, r in enumerate(new)]
    held = [(1000 + i, *r) for i, r in enumerate(existing)]
    out = verdicts.rescanned(spark.createDataFrame(rows, FILE), spark.createDataFrame(held, FILE + ", book long"), spark.createDataFrame(list(shells), SHELL), mode)
    found = {r.file: r for r in out.collect()}
    assert sorted(found) == list(range(len(rows)))
    return {f"{r[2]}/{r[3]}": (found[r[0]].decision, found[r[0]].target, found[r[0]].weak_match, found[r[0]].reason) for r in rows}


def short(found):
    return {k: v[:2] for k, v in found.items()}


def test_folder_books(spark):
    new = [(1, "a", n, w) for n, w in [("Emma (1).epub", None), ("Emma.mobi", None), ("Dune - Copy.epub", None), ("Ada (2001).epub", None), ("Twins.pdf", None), ("(Digital).cbz", None), ("!!!.pdf", None), ("Lost.epub", None), ("Kim.epub", "Ann Bee"), ("Ivy.epub", "Cy Dee")]]
    old = [(1, "a", "Emma.epub", None, 1), (1, "a", "Dune.pdf", None, 2), (1, "a", "Ada (1999).epub", None, 3), (1, "a", "Twins.epub", None, 4), (1, "a", "The Twins.epub", None, 5)]
    old += [(1, "a", "(Retail).epub", None, 6), (1, "b", "Lost.pdf", None, 7), (1, "a", "The Kim.pdf", "Zoe Fox", 8), (1, "a", "The Ivy.pdf", "C. Dee", 9)]
    found = decided(spark, new, old)
    assert short(found) == {
        "a/Emma (1).epub": ("attach-same-folder", "1"),
        "a/Emma.mobi": ("attach-same-folder", "1"),
        "a/Dune - Copy.epub": ("attach-same-folder", "2"),
        "a/Ada (2001).epub": ("new-book", "-"),
        "a/Twins.pdf": ("ambiguous", "-"),
        "a/(Digital).cbz": ("new-book", "-"),
        "a/!!!.pdf": ("new-book", "-"),
        "a/Lost.epub": ("new-book", "-"),
        "a/Kim.epub": ("new-book", "-"),
        "a/Ivy.epub": ("attach-same-folder", "9"),
    }
    assert found["a/Ada (2001).epub"][3] == "folder: the books with this title are another author's or year's"
    assert found["a/Twins.pdf"][3] == "folder: several books in the folder have this title"


def test_base_name_is_one_book(spark):
    assert short(decided(spark, [(1, "a", "!!!.pdf", None)], [(1, "a", "!!!.epub", "Ann Bee", 4)])) == {"a/!!!.pdf": ("attach-same-folder", "4")}


def test_shells(spark):
    who = {"ann": "Ann Bee", "bare": "Bee", "initial": "A. Bee", "other": "Zoe Bee"}
    new = [(1, k, n, w) for k, w in who.items() for n in (f"Long {k}.epub", f"{k.title()}.epub")] + [(1, "none", "Long none.epub", None), (1, "physical", "Long physical.epub", None), (2, "away", "Long away.epub", "Ann Bee"), (1, "blank", "???.epub", "Ann Bee")]
    shells = [(10 * i + j, None, n, "Ann Bee", False, None) for i, k in enumerate(who, 1) for j, n in enumerate((f"Long {k}", k.title()))]
    shells += [(91, None, "Long none", None, False, None), (92, None, "Long physical", None, True, None), (93, 1, "Long away", "Ann Bee", False, None), (94, None, "!!", "Ann Bee", False, None)]
    assert short(decided(spark, new, shells=shells)) == {
        "ann/Long ann.epub": ("attach-shell", "10"),
        "ann/Ann.epub": ("attach-shell", "11"),
        "bare/Long bare.epub": ("new-book", "-"),
        "bare/Bare.epub": ("new-book", "-"),
        "initial/Long initial.epub": ("attach-shell", "30"),
        "initial/Initial.epub": ("new-book", "-"),
        "other/Long other.epub": ("new-book", "-"),
        "other/Other.epub": ("new-book", "-"),
        "none/Long none.epub": ("new-book", "-"),
        "physical/Long physical.epub": ("attach-shell", "92"),
        "away/Long away.epub": ("new-book", "-"),
        "blank/???.epub": ("new-book", "-"),
    }


def test_alike_shells_copies_and_volumes(spark):
    new = [(1, f, n, "Ann Bee") for f, n in [("a", "Red Sky.epub"), ("b", "Blue Sky (1).epub"), ("c", "Green Sky (1).epub"), ("d", "Gray Sky.epub"), ("e", "Pink Sky (2).epub"), ("f", "Two Skies (1).epub"), ("g", "Low Sky (1).cbz")]]
    shells = [(1, None, "Red Sky", "Ann Bee", True, None), (2, None, "Red Sky", "Bee, Ann", False, None), (3, None, "Blue Sky", "Ann Bee", False, None), (4, None, "Green Sky", "Ann Bee", False, 2.0)]
    shells += [(5, None, "Gray Sky", "Ann Bee", False, 1.0), (6, None, "Gray Sky", "Ann Bee", False, 1.5), (7, None, "Pink Sky", "Ann Bee", False, None), (8, None, "Two Skies", "Ann Bee", False, 2.0), (9, None, "Two Skies", "Ann Bee", False, None), (10, None, "Low Sky", "Ann Bee", False, None)]
    found = decided(spark, new, shells=shells)
    assert {k: v[:3] for k, v in found.items()} == {
        "a/Red Sky.epub": ("attach-shell", "2", "attached"),
        "b/Blue Sky (1).epub": ("attach-shell", "3", "attached"),
        "c/Green Sky (1).epub": ("new-book", "-", "-"),
        "d/Gray Sky.epub": ("ambiguous", "-", "-"),
        "e/Pink Sky (2).epub": ("new-book", "-", "-"),
        "f/Two Skies (1).epub": ("ambiguous", "-", "-"),
        "g/Low Sky (1).cbz": ("new-book", "-", "-"),
    }
    assert found["a/Red Sky.epub"][3] == "fileless: title and author agree, one of 2 alike books"


def test_followers_splits_and_refusals(spark):
    # a file without a match follows; files that match two books split; a file that says no takes the group along
    new = [(1, "f", "Sun Rise.epub", "Ann Bee"), (1, "f", "Sun Rise.pdf", None), (1, "f", "Sun Rise (2).mobi", None)]
    new += [(1, "r", "Moon Set.epub", "Ann Bee"), (1, "r", "Moon Set.pdf", None)]
    new += [(1, "s", "Star.epub", None), (1, "s", "Star.pdf", None)]
    old = [(1, "s", "Star.epub", None, 7), (1, "s", "The Star (1).pdf", None, 8), (1, "r", "Moon Set (1999).azw3", "Zoe Fox", 9)]
    shells = [(1, None, "Sun Rise", "Ann Bee", False, None), (2, None, "Moon Set", "Ann Bee", False, None)]
    found = decided(spark, new, old, shells)
    assert found["f/Sun Rise.epub"][:2] == ("attach-shell", "1") and found["f/Sun Rise.pdf"][1:4:2] == ("1", "group: follows the files that it would be one book with")
    assert found["f/Sun Rise (2).mobi"][:2] == ("attach-shell", "1")
    # the epub, by another author than the book of the folder, refuses it; the pdf matched it, and a strong match of each differs
    assert {found[f"r/Moon Set.{e}"][0] for e in ("epub", "pdf")} == {"ambiguous"}
    assert found["r/Moon Set.pdf"][3] == "group: its files match different books"


def test_refused_group(spark):
    new = [(1, "a", "Late Tea.epub", "Ann Bee"), (1, "a", "Late Tea.pdf", None)]
    old = [(1, "a", "Late Tea (1).azw3", "Zoe Fox", 3)]
    found = decided(spark, new, old)
    assert {v[0] for v in found.values()} == {"ambiguous"} and {v[3] for v in found.values()} == {"group: a file of it is not its book"}


def test_weak_against_strong_in_a_group(spark):
    new = [(1, "a", "Old Oak.epub", "Ann Bee"), (1, "a", "The Old Oak (1).pdf", "Ann Bee")]
    shells = [(1, None, "Old Oak", "Ann Bee", False, None), (2, None, "Old Oak 1", "Ann Bee", False, None)]
    found = decided(spark, new, shells=shells)
    # the copy's name is also a first volume's: a strong match of its own, so the files match different books
    assert {v[3] for v in found.values()} == {"group: its files match different books"}
    shells = [(1, None, "Old Oak", "Ann Bee", False, None), (2, None, "Old Oak", "Ann Bee", False, None)]
    found = decided(spark, [*new, (1, "a", "Old Oak.mobi", None)], [(1, "a", "Old Oak.mobi", None, 5)], shells)
    assert {v[:2] for v in found.values()} == {("attach-same-folder", "5")}


def test_claims(spark):
    new = [(1, "a", "One Hill.epub", "Ann Bee"), (1, "b", "One Hill.epub", "Ann Bee")]
    new += [(1, "a/in", "Two Hills.epub", "Ann Bee"), (1, "a", "Two Hills (1).epub", "Ann Bee")]
    new += [(1, "c", "Three Hills.epub", "Ann Bee"), (1, "c", "The Three Hills.epub", "Ann Bee"), (1, "d", "Four Hills.epub", "Ann Bee"), (1, "d", "Four Hills (1).epub", "Ann Bee"), (1, "d", "Four Hills.pdf", "Ann Bee")]
    new += [(1, "e", "Five Hills (Part 1).m4b", "Ann Bee"), (1, "e", "Five Hills (Part 2).m4b", "Ann Bee")]
    shells = [(i, None, f"{n} Hill{'s' * (i > 1)}", "Ann Bee", False, None) for i, n in enumerate(("One", "Two", "Three", "Four"), 1)] + [(5, None, "Five Hills 1", "Ann Bee", False, None)]
    found = decided(spark, new, shells=shells)
    assert {k: v[:3] for k, v in found.items()} | {"e/Five Hills (Part 1).m4b": 0, "e/Five Hills (Part 2).m4b": 0} == {
        "a/One Hill.epub": ("ambiguous", "-", "-"),
        "b/One Hill.epub": ("ambiguous", "-", "-"),
        "a/in/Two Hills.epub": ("attach-shell", "2", "-"),
        "a/Two Hills (1).epub": ("ambiguous", "-", "yielded"),
        "c/Three Hills.epub": ("ambiguous", "-", "-"),
        "c/The Three Hills.epub": ("ambiguous", "-", "-"),
        "d/Four Hills.epub": ("attach-shell", "4", "-"),
        "d/Four Hills (1).epub": ("attach-shell", "4", "agrees"),
        "d/Four Hills.pdf": ("attach-shell", "4", "-"),
        "e/Five Hills (Part 1).m4b": 0,
        "e/Five Hills (Part 2).m4b": 0,
    }
    assert found["a/One Hill.epub"][3] == "claims: claimed by files of several folders"
    assert found["c/Three Hills.epub"][3] == "claims: claimed by different files of one format"


def test_book_per_folder(spark):
    old = [(1, "A/T", "T.epub", None, 1), (1, "B/T", "T.epub", None, 2), (1, "B/T", "U.epub", None, 3), (1, "C", "C.epub", None, 4), (1, "C/x", "x.epub", None, 5), (1, "D/T", "only.m4b", None, 6)]
    new = [(1, f, n, None) for f, n in [("A/T", "whatever.pdf"), ("A/T/audio/one", "01.m4b"), ("A/T/audio/one", "02.m4b"), ("A/T/extra", "z.pdf"), ("B/T", "v.epub"), ("B/T/a", "v.m4b"), ("C/x/y", "y.mp3"), ("", "root.epub"), ("D/T/audio", "p.m4b"), ("E/F", "new.epub"), ("E/F/g/h", "01.m4b")]]
    found = decided(spark, new, old, [(9, None, "New", None, True, None)], "BOOK_PER_FOLDER")
    assert short(found) == {
        "A/T/whatever.pdf": ("attach-same-folder", "1"),
        "A/T/audio/one/01.m4b": ("attach-same-folder", "1"),
        "A/T/audio/one/02.m4b": ("attach-same-folder", "1"),
        "A/T/extra/z.pdf": ("new-book", "-"),
        "B/T/v.epub": ("ambiguous", "-"),
        "B/T/a/v.m4b": ("ambiguous", "-"),
        "C/x/y/y.mp3": ("attach-same-folder", "5"),
        "/root.epub": ("new-book", "-"),
        "D/T/audio/p.m4b": ("new-book", "-"),
        "E/F/new.epub": ("attach-shell", "9"),
        "E/F/g/h/01.m4b": ("attach-shell", "9"),
    }


def test_book_per_file(spark):
    new = [(1, "a", "Big Sea.epub", "Ann Bee"), (1, "a", "Big Sea.pdf", "Ann Bee"), (1, "b", "Far Sea.epub", "Ann Bee")]
    old = [(1, "b", "Far Sea.pdf", "Ann Bee", 5)]
    shells = [(1, None, "Big Sea", "Ann Bee", False, None), (2, None, "Far Sea", "Ann Bee", False, None)]
    found = decided(spark, new, old, shells, "BOOK_PER_FILE")
    assert short(found) == {"a/Big Sea.epub": ("ambiguous", "-"), "a/Big Sea.pdf": ("ambiguous", "-"), "b/Far Sea.epub": ("attach-shell", "2")}


def test_nulls_and_no_rows(spark):
    found = decided(spark, [(1, "a", "", None), (1, None, None, None), (None, "b", "x.epub", "")], [(1, None, None, None, 7), (1, "a", None, "", 8)], [(None, None, None, None, None, None), (3, None, "x", "", False, None)])
    assert short(found) == {"a/": ("attach-same-folder", "8"), "None/None": ("attach-same-folder", "7"), "b/x.epub": ("new-book", "-")}
    assert verdicts.rescanned(spark.createDataFrame([], FILE), spark.createDataFrame([], FILE + ", book long"), spark.createDataFrame([], SHELL)).count() == 0
    with pytest.raises(ValueError):
        decided(spark, [(1, "a", "x.epub", None)], mode="NONE")
