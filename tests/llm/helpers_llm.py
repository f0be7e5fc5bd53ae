import re


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
