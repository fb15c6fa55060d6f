import re

WORDS = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}


def toxic_words(text: str) -> int:
    return sum(w in WORDS for w in re.findall(r"[^\W_]+", text.lower()))
