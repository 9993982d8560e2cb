"""Rules for URLs as text, one a line: ``VERDICT KIND PATTERN``; ``#`` begins a comment.

``VERDICT`` is ``allow`` or ``block``.  ``KIND`` is one of

* ``site``: ``host/path`` fits the host with all its subdomains where the URL's path starts with the rule's;
* ``host``: words that stand in the host as they are, between dots or hyphens;
* ``path``: words that stand in the path as they are, between ``/ _ . -`` or at its end.
"""

#: Site rules of the query.
SITES = """
allow site org/
block site example.org/es/
block site example.org/en/1
allow site com/fr/
block site com/de/
"""

#: Words that hosts of unwanted kinds carry.
_HOSTS = {
    "gambling": "casino casinos bet bets betting bookmaker bookmakers gamble gambling jackpot lottery lotto poker roulette slots sportsbet baccarat blackjack",
    "pharmacy": "cheap-pills pills viagra cialis levitra pharmacy-online online-pharmacy meds-online no-prescription xanax tramadol steroids weight-loss diet-pills",
    "adult": "adult adults porn porno xxx sex sexy nude nudes erotic escort escorts hentai milf camgirls webcams hookup fetish",
    "advertising": "ad-server adserver adservice ads ads-track adtrack adtracker doubleclick popads popunder clickbait click-bait clicktrack tracker trackers traffic-exchange",
    "link farms": "spam spam-farm link-farm linkfarm backlinks link-exchange seo-links free-traffic article-spinner doorway",
    "malware": "malware phishing phish keylogger trojan botnet ransomware exploit-kit scam scams",
    "piracy": "warez crack cracks cracked keygen keygens nulled torrent torrents serials free-movies-online full-download",
    "money": "payday payday-loans paydayloans quick-loans easy-loans fast-cash get-rich make-money forex-signals binary-options pyramid free-bitcoin crypto-doubler replica-watches replicas fake-ids free-gift-cards giveaway-win",
}
_PATHS = "casino poker-online viagra cialis porn porno xxx warez keygen nulled payday-loans cheap-pills free-bets click-bait"

#: The default list: site rules first, then unwanted words of hosts and paths.
DEFAULT = SITES + "".join(f"block host {w}\n" for words in _HOSTS.values() for w in words.split()) + "".join(f"block path {w}\n" for w in _PATHS.split())
