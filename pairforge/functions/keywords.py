"""Language keyword lists used by the keyword-weighted n-gram match."""
from __future__ import annotations

# --- fixed values: Java keywords (50), in their natural order ---
JAVA = """abstract assert boolean break byte case catch char class const continue default do double else enum extends
final finally float for goto if implements import instanceof int interface long native new package private protected
public return short static strictfp super switch synchronized this throw throws transient try void volatile while""".split()

# --- fixed values: C# keywords and contextual keywords (107), in their natural order ---
C_SHARP = """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double
else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock
long namespace new null object operator out override params private protected public readonly ref return sbyte sealed
short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using
virtual void volatile while add alias ascending async await by descending dynamic equals from get global group into join
let nameof notnull on orderby partial remove select set unmanaged value var when where yield""".split()

KEYWORDS = {"java": JAVA, "c_sharp": C_SHARP}


def keywords_for(lang: str) -> list[str]:
    """Keyword list for ``lang``; only java and c_sharp ship lists."""
    return KEYWORDS[lang]
