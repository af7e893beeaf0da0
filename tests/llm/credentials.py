"""Held-out texts with one credential each, in forms that the tagger's own generator doesn't make."""

import random
import string

ALNUM = string.ascii_letters + string.digits
PROSE = ["please rotate this soon", "see the wiki page", "deployed on monday by ops", "do not share", "this was found in the logs", "Das ist ein Beispiel", "une autre ligne ici"]
#: Lead, whether any value may follow (or only one that its shape tells), and tail.
FORMS = [
    ('curl -H "Authorization: Bearer ', False, '" https://api.example.com'), ("export DEPLOY_KEY=", False, ""), ('{"private_key": "', False, '", "id": 7}'), ("smtp_pass: ", True, ""), ("pwd = '", True, "'"), ("auth: ", False, ""), ("my key is ", False, " ok"), ("found `", False, "` in the repo"),
    ("access_key=", False, ";region=eu"), ("login pass: ", True, ""), ("session=", False, ""), ("use ", False, " for now"), ('db_pwd: "', True, '"'), ("webhook_auth: ", False, ""), ("", False, ""), ("Credential ", False, ""),
]


def texts(n, seed=3):
    """(text, start, end) of n texts."""
    r = random.Random(seed)
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    for _ in range(n):
        value = r.choice([
            lambda: some(ALNUM, 20, 40), lambda: some(string.ascii_letters, 20, 36), lambda: some(string.ascii_lowercase + string.digits, 20, 32), lambda: some(ALNUM + "_-", 24, 40), lambda: "github_pat_" + some(ALNUM, 22, 40), lambda: "pk_live_" + some(ALNUM, 24, 24),
            lambda: "xapp-" + some(string.ascii_uppercase, 20, 20), lambda: "eyJ" + some(ALNUM, 17, 20) + "." + some(ALNUM, 30, 60) + "." + some(ALNUM + "-_", 30, 43), lambda: some(ALNUM + "+/", 40, 60) + "==",
        ])()
        lead, anything, tail = r.choice(FORMS)
        if anything:
            value = r.choice([value, some(ALNUM, 10, 16), some(string.ascii_lowercase, 10, 20), r.choice(["sunshine", "purple", "falcon"]) + r.choice(["monkey", "tower", "rain"]) + some(string.digits, 0, 3), some(string.digits, 6, 10)])
        start = f"{r.choice(PROSE)}. {lead}"
        yield f"{start}{value}{tail} {r.choice(PROSE)}", len(start), len(start) + len(value)
