"""Cheap checks in front of page patterns let every match through."""

import random
import re

from tidemark.functions import page_rules as P
from tidemark.functions import rules as R
from tidemark.operators.page_extract import folded, hosts_in


def test_page_patterns_hold_their_words():
    for pattern, text in [
        (P.CONCAT_EMAIL, '"a" + "@" + "b.co"'), *((P.FEED, f"https://A.test{end}") for end in ("/FEED.xml", "/rss.xml", "/atom.xml", "/index.xml", "/feeds/posts/default", "/feed/rss2", "/feed/atom", "/feed", "/rss", "?feed=rss", "?feed=atom", "?feed=rdf")),
        *((P.INTERNAL_IP, f"{start}.1.1.1"[: 7 + len(start)]) for start in ("10", "127")), *((P.INTERNAL_IP, f"{start}.1.1") for start in ("192.168", "172.16", "172.31", "169.254", "100.64", "100.127")),
        *((P.PGP_SERVER, f"https://{host}/x") for host in ("keys.openpgp.org", "PGP.mit.edu", "keyserver.ubuntu.com", "keys.gnupg.net", "pgp.surf.nl", "pgp.surfnet.nl", "sks-keyservers.net", "pgpkeys.eu", "keys.mailvelope.com", "a.test/pks/lookup")),
        (P.KEYBASE, "Keybase.io/bob"), *((p, u) for (p, _), u in zip(P.SITE_FILES, ("/sitemap_index.xml", "/sitemap.xml", "/sitemap-a.xml", "/robots.txt", "/humans.txt", "/.well-known/security.txt", "/security.txt", "/ads.txt", "/app-ads.txt"), strict=True)),
    ]:
        assert re.search(pattern, text) and any(w in folded(text) for w in P.WORDS_OF[pattern]), text


def test_hosts_are_those_of_one_pattern_over_the_text():
    draw = random.Random(4)
    for domain in ("a.co", "a.a", "x-y.test"):
        pattern = re.compile(rf"([a-zA-Z0-9]([a-zA-Z0-9\-]{{0,61}}[a-zA-Z0-9])?\.{re.escape(domain)})")
        for _ in range(3000):
            text = "".join(draw.choice([f".{domain}", f"{domain}", "a", "-", ".", "é", "b" * draw.randint(55, 70), " ", "/", "%2F"]) for _ in range(draw.randint(0, 12)))
            assert list(hosts_in(text, domain)) == [(m.start(), m.group()) for m in pattern.finditer(text)], text


def test_cheap_patterns_are_found_wherever_a_longer_one_is():
    fingerprints = [" ".join(["ABCD"] * 10), "\t".join(["0123abcd"] * 5), "f" * 40]
    for text, longer, cheap in [
        ("+1 (669) 555-72", P.PHONE, P.TWO_DIGITS), ("(800) 555-1234", P.PHONE, P.TWO_DIGITS), ("01 42 68", P.PHONE, P.TWO_DIGITS), ("٠١ ٤٢ ٦٨", P.PHONE, P.TWO_DIGITS),
        *((f, P.PGP_FINGERPRINTS[k], (P.HEX_GROUPS, P.HEX_GROUPS, P.HEX_RUN)[k]) for k, f in enumerate(fingerprints)),
        ("AC" + "0" * 32, dict(R.API_KEYS)["Twilio"], P.HEX_RUN), ("a" * 32, P.CAPTCHA_KEYS[4][1], P.HEX_RUN),
        *((start + "4" * (n - len(start)), p, P.COIN_RUN) for (_, p, how, _), start, n in zip(P.COINS, ("1", "", "L", "", "D5", "T", "r", "4A", "1"), (26, 0, 26, 0, 34, 34, 25, 95, 32), strict=True) if how != "bech32"), ("0x" + "a" * 40, P.ETHEREUM, P.COIN_RUN),
    ]:
        assert re.search(longer, text) and re.search(cheap, text), (text, longer)
