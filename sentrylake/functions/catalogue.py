"""The monitored brands and the word lists of the scoring rules. Everything here is a fixed value that results depend on."""

# Brand, display name, keywords, owned registered domains, phishing-report contacts; in catalogue order.
BRANDS = [
    ("phonepe", "PhonePe", ["phonepe"], ["phonepe.com"], []),
    ("gpay", "Google Pay", ["gpay", "googlepay"], ["google.com", "gpay.app", "pay.google.com"], []),
    ("paytm", "Paytm", ["paytm"], ["paytm.com", "paytm.in", "paytmbank.com", "paytmpayments.com", "paytmpayments.in", "paytmmoney.com", "paytminsurance.co.in", "paytm.bank.in", "paytmmall.com"], []),
    ("bhim", "BHIM UPI", ["bhim", "upi"], ["bhimupi.org.in", "npci.org.in"], []),
    ("sbi", "State Bank of India", ["sbi", "yono"], ["onlinesbi.sbi", "sbi.co.in", "yonobusiness.sbi", "sbi.bank.in", "onlinesbi.com", "sbicard.com", "yonosbi.com", "yonosbi.sbi", "sbilife.co.in", "sbimf.com", "sbigeneral.in", "sbisecurities.in", "sbicaps.com"], []),
    ("hdfc", "HDFC Bank", ["hdfc"], ["hdfcbank.com", "hdfc.bank.in", "hdfcbank.bank.in", "hdfc.com", "hdfcbank.net", "hdfclife.com", "hdfcergo.com", "hdfcfund.com", "hdfcsec.com", "hdfcsky.com"], ["report.phishingsite@hdfc.bank.in"]),
    ("icici", "ICICI Bank", ["icici"], ["icicibank.com", "icici.bank.in", "icicibank.co.in", "icicidirect.com", "iciciprulife.com", "icicilombard.com", "icicipruamc.com", "icicisecurities.com"], ["antiphishing@icicibank.com"]),
    ("axisbank", "Axis Bank", ["axisbank"], ["axisbank.com", "axis.bank.in", "axisbank.co.in", "axismf.com", "axisdirect.in"], []),
]
# Top-level domains that belong to one brand; suffixes under which names are registered.
BRAND_TLDS = {"sbi": "sbi"}
EXTRA_SUFFIXES = ["bank.in", "fin.in"]
CC_SECOND_LEVEL = ["co", "com", "net", "org", "gov", "ac", "edu", "res", "gen", "firm", "ind"]
# Words that a short keyword may stand next to within a host label.
CONTEXT_WORDS = """bank banking netbanking net online internet mobile app apps apk web portal secure security safe login
signin logon auth verify verification verified kyc ekyc update updates upgrade reward rewards point points redeem cashback
refund refunds claim bonus gift offer offers prize win card cards credit debit pay payment payments upi wallet account
accounts acc customer care support help helpdesk desk service services official india in ind bharat loan loans apply pan
aadhar aadhaar link block blocked unblock unlock activate activation reactivate alert notice limit yono lite rbi npci home
my e i m go get new now pro plus center centre team id otp pin mpin transfer money cash fund funds txn co corp fin""".split()
# Top-level domains with much abuse, terms and lures in hosts and URLs.
SUSPICIOUS_TLDS = """xyz top click live icu site online shop buzz cfd sbs cyou pw tk ml ga cf gq club rest bond autos lol mom
quest monster cam pics boats help support info cc ws vip work life store fun space website tech today win loan link""".split()
BANKING_TERMS = "netbanking internetbanking onlinebank online benefit reward kyc pan rewards points redeem creditcard support helpdesk customercare secure".split()
LURE_WORDS = "verify kyc update reward cashback refund secure login claim blocked".split()
# Shorteners, hosting suffixes in the order that they're tried, and words near a keyword that aren't typos.
SHORTENERS = """bit.ly tinyurl.com is.gd cutt.ly t.ly rb.gy shorturl.at goo.gl ow.ly t.co buff.ly rebrand.ly tiny.cc s.id v.gd
shorte.st bitly.com lnkd.in surl.li clck.ru qr.ae u.to short.gy urlz.fr bl.ink tny.im""".split()
FREE_HOSTING = """vercel.app netlify.app web.app firebaseapp.com pages.dev workers.dev github.io gitlab.io 000webhostapp.com
replit.app repl.co glitch.me herokuapp.com onrender.com blogspot.com weebly.com wixsite.com webflow.io framer.app
godaddysites.com sites.google.com ngrok-free.app ngrok.io trycloudflare.com duckdns.org serveo.net azurewebsites.net
web.core.windows.net appspot.com surge.sh fly.dev railway.app carrd.co square.site mystrikingly.com wordpress.com ipfs.io
dweb.link""".split()
TYPO_ALLOWED = ["payment", "paytime", "paytv", "phoneme", "phonebe"]
# Look-alikes from other scripts, and digits read as letters.
CONFUSABLES = ("авсеёһіјкмнорԛѕтухԝьαβεηικνορτυχωӏɑɡı", "abceehijkmhopqstyxwbabenikvoptuxwlagi")
DIGIT_LETTERS = ("0134578", "oleastb")
# Entity types that link, those too common to link alone, those shared by the customers of a network.
LINKING = ["ip", "asn", "cert_fingerprint", "upi_id", "phone", "telegram", "favicon_hash", "analytics_id", "registrar", "domain", "package_name", "apk_sha256", "signing_cert"]
WEAK = ["registrar", "asn"]
SHARED_ON_CDN = ["ip", "cert_fingerprint"]
SHARED_SIGNING_CERTS = ["a40da80a59d170caa950cf15c18c454d47a39b26989d8b640ecd745ba71bf5dc"]
# How a candidate uses an entity of a type.
RELATIONS = {
    "ip": "hosted_on", "asn": "in_network", "cert_fingerprint": "serves_certificate", "registrar": "registered_with", "upi_id": "collects_payments_to", "phone": "lists_contact", "telegram": "uses_telegram",
    "favicon_hash": "shares_asset", "analytics_id": "shares_tracking_id", "domain": "communicates_with", "package_name": "app_package", "apk_sha256": "app_build", "signing_cert": "signed_with",
}
# Abuse channels of hosting platforms, and of recipients that have one channel.
PLATFORM_ABUSE = {
    "pages.dev": "https://abuse.cloudflare.com/", "workers.dev": "https://abuse.cloudflare.com/", "trycloudflare.com": "https://abuse.cloudflare.com/",
    "vercel.app": "https://vercel.com/abuse", "netlify.app": "fraud@netlify.com", "github.io": "https://support.github.com/contact/report-abuse",
    "azurewebsites.net": "https://msrc.microsoft.com/report/abuse", "web.core.windows.net": "https://msrc.microsoft.com/report/abuse",
    "000webhostapp.com": "abuse@hostinger.com", "godaddysites.com": "abuse@godaddy.com",
    "web.app": "https://safebrowsing.google.com/safebrowsing/report_phish/", "firebaseapp.com": "https://safebrowsing.google.com/safebrowsing/report_phish/",
    "appspot.com": "https://safebrowsing.google.com/safebrowsing/report_phish/", "sites.google.com": "https://safebrowsing.google.com/safebrowsing/report_phish/",
    "blogspot.com": "https://safebrowsing.google.com/safebrowsing/report_phish/",
}
FIXED_CHANNELS = {
    "cert_in": ["incident@cert-in.org.in"], "safe_browsing": ["https://safebrowsing.google.com/safebrowsing/report_phish/", "https://www.microsoft.com/en-us/wdsi/support/report-unsafe-site"],
    "app_store": ["https://safebrowsing.google.com/safebrowsing/report_badware/"], "npci": ["https://www.npci.org.in/register-a-complaint"],
    "cybercrime_portal": ["https://cybercrime.gov.in/", "National cybercrime helpline 1930"], "telecom": ["https://sancharsaathi.gov.in/sfc/"],
}
# Message rules as name, hundredths and pattern (case doesn't count), in order.
MESSAGE_RULES = [
    ("kyc_lure", 20, r"\b(e?kyc|pan(?: card)?|aadha?ar|update (?:your )?(?:details|account|kyc|pan)|re-?verify|verification)\b"),
    ("account_threat", 15, r"\b(blocked|suspended|deactivated|frozen|closed|on hold|restricted)\b"),
    ("urgency", 10, r"\b(today|immediately|urgent(?:ly)?|within \d+ ?(?:hours?|hrs?|minutes?|mins?)|last date|final (?:notice|warning)|expire[sd]?|will be (?:blocked|suspended|closed|deactivated))\b"),
    ("reward_lure", 15, r"\b(cash ?back|refund|reward(?: points)?|prize|lottery|won|bonus|gift|redeem|claim)\b"),
    ("credential_request", 25, r"\b(otp|upi pin|mpin|cvv|password|card number)\b"),
    ("app_install_request", 20, r"\b(install|download)\b.{0,40}\b(app|apk|application)\b|\.apk\b"),
]
PAYMENT_REQUEST = r"(?:\b(?:pay|send|transfer|deposit)\b|₹|\brs\.? ?\d|\binr\b)"
CALLBACK = r"\b(call|whatsapp|contact|helpline|customer care|support)\b"
# Patterns of indicators in text.
URL = r"(?i)(?:https?://|www\.)[^\s<>\"']+"
UPI = r"\b[a-zA-Z0-9.\-_]{2,}@[a-zA-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?91[\-\s]?)?[6-9]\d{9}(?!\d)"
TELEGRAM_LINK = r"(?i)(?:https?://)?(?:www\.)?t(?:elegram)?\.me/(\+?[a-zA-Z0-9_]{3,})"
TELEGRAM_HANDLE = r"(?<![a-zA-Z0-9@._\-])@([a-zA-Z][a-zA-Z0-9_]{4,31})\b"
# Signs of pages that are gone or guarded.
OFFLINE_MARKERS = [
    "deployment_disabled", "this deployment is unavailable", "deployment_not_found", "site not found", "this site has been suspended", "account has been suspended", "this account has been suspended", "website is no longer available",
    "page not found", "404 not found", "no such app", "there isn't a github pages site here", "this site can't be reached", "domain has expired", "this domain is parked", "web site currently not available",
]
CHALLENGE_MARKERS = ["just a moment", "attention required", "checking your browser", "verify you are human", "cf-challenge", "challenges.cloudflare.com", "g-recaptcha", "hcaptcha.com/1/api.js", "ddos-guard", "captcha-delivery"]
# Words that name fields for credentials, those of them that weigh most, and prompts for credentials.
SENSITIVE_FIELDS = "upi_pin upipin mpin upi-pin otp one_time onetime cvv card cardnumber cardno expiry password passwd pwd pin atm".split()
STRONG_FIELDS = "upi_pin upipin mpin otp cvv".split()
HARVEST_PROMPTS = [
    "enter your upi pin", "enter upi pin", "enter otp", "verify otp", "enter your otp", "enter card number", "enter your card number", "enter cvv", "enter your cvv", "net banking password", "enter your password",
    "atm pin", "enter your aadhaar", "update your kyc", "complete your kyc", "complete kyc", "verify your account", "account will be blocked", "account has been blocked", "account will be suspended",
]
# Patterns of scripts that hide what they do, with their labels.
OBFUSCATION = [
    (r"\beval\s*\(", "eval("), (r"\batob\s*\(", "atob("), (r"\bunescape\s*\(", "unescape("), (r"\bescape\s*\(", "escape("), (r"document\.write\s*\(", "document.write("),
    (r"String\.fromCharCode\s*\(", "String.fromCharCode("), (r"\bFunction\s*\(\s*['\"]", 'Function("...")'), (r"[A-Za-z0-9+/]{120,}={0,2}", "long base64 blob"),
]
# What genuine pages of a brand show: words of the title, vocabulary, markers.
LOOKS = [
    ("phonepe", ["phonepe"], "phonepe upi pay wallet payment secure money transaction".split(), ["phonepe", "upi"]),
    ("gpay", ["google", "pay", "gpay"], "google pay gpay upi payment secure money wallet".split(), ["google pay", "gpay", "upi"]),
    ("paytm", ["paytm"], "paytm wallet upi pay recharge payment secure money".split(), ["paytm", "upi"]),
    ("bhim", ["bhim", "upi"], "bhim upi npci pay payment secure money vpa".split(), ["bhim", "upi", "npci"]),
    ("sbi", ["sbi", "state", "bank"], "sbi state bank india login netbanking account secure upi".split(), ["onlinesbi", "state bank", "sbi"]),
    ("hdfc", ["hdfc", "bank"], "hdfc bank netbanking login account secure customer upi".split(), ["hdfc", "netbanking"]),
    ("icici", ["icici", "bank"], "icici bank netbanking login account secure customer upi".split(), ["icici", "netbanking"]),
    ("axisbank", ["axis", "bank"], "axis bank netbanking login account secure customer upi".split(), ["axis", "netbanking"]),
]
# Similarities from which a screenshot matches or resembles, an icon matches, an app's icon matches.
SCREENSHOT_MATCH, SCREENSHOT_LIKE, ICON_LOOK, APP_ICON = 0.85, 0.75, 0.90, 0.88
# Networks whose addresses front many unrelated customers.
SHARED_NETWORKS = "AS13335 AS209242 AS20940 AS16625 AS54113 AS15169 AS396982 AS16509 AS14618 AS8075 AS36459 AS47583 AS26496 AS22612 AS46606 AS19527 AS32934 AS60068 AS21859".split()
# Hosts that come with development kits and messengers; their registered domains identify no campaign.
PLATFORM_HOSTS = """android.com google.com googleapis.com gstatic.com googleusercontent.com google-analytics.com
googlesyndication.com doubleclick.net firebaseio.com firebase.com crashlytics.com facebook.com fb.com fbcdn.net apache.org w3.org
xml.org xmlpull.org json.org github.com jetbrains.com kotlinlang.org schemas.microsoft.com adobe.com mozilla.org example.com
localhost play.google.com youtube.com gradle.org squareup.com okhttp3 appsflyer.com branch.io adjust.com onesignal.com sentry.io
bugsnag.com amazonaws.com t.me telegram.me telegram.org wa.me whatsapp.com whatsapp.net""".split()
# Official app packages; names of the companies behind the brands.
PACKAGES = {
    "phonepe": ["com.phonepe.app"], "gpay": ["com.google.android.apps.nbu.paisa.user"], "paytm": ["net.one97.paytm"], "bhim": ["in.org.npci.upiapp"], "sbi": ["com.sbi.lotusintouch", "com.sbi.SBIFreedomPlus"],
    "hdfc": ["com.hdfcbank.android.now", "com.snapwork.hdfc", "com.hdfcbank.payzapp"], "icici": ["com.csam.icici.bank.imobile"], "axisbank": ["com.axis.mobile"],
}
LEGAL_NAMES = {
    "phonepe": ["phonepe private limited", "phonepe limited"], "gpay": ["google llc"], "paytm": ["one 97 communications limited", "paytm payments bank limited", "paytm money limited", "paytm payments services limited"],
    "bhim": ["national payments corporation of india"], "sbi": ["state bank of india"], "hdfc": ["hdfc bank limited"], "icici": ["icici bank limited"], "axisbank": ["axis bank limited"],
}
# Permissions of apps with their signal and hundredths; of two that give one signal the first counts.
RISKY_PERMISSIONS = [
    ("android.permission.RECEIVE_SMS", "sms_interception", 30), ("android.permission.READ_SMS", "sms_interception", 30), ("android.permission.SEND_SMS", "sms_sending", 15),
    ("android.permission.BIND_ACCESSIBILITY_SERVICE", "accessibility_abuse", 25), ("android.permission.SYSTEM_ALERT_WINDOW", "overlay_capability", 10),
    ("android.permission.BIND_NOTIFICATION_LISTENER_SERVICE", "notification_access", 15), ("android.permission.REQUEST_INSTALL_PACKAGES", "package_installation", 10),
    ("android.permission.CALL_PHONE", "call_control", 5), ("android.permission.CALL_FORWARDING", "call_control", 15), ("android.permission.READ_CALL_LOG", "call_log_access", 5),
    ("android.permission.READ_CONTACTS", "contacts_access", 5), ("android.permission.QUERY_ALL_PACKAGES", "app_inventory", 5),
]
# Patterns of indicators in the strings of apps, and wording beside which a number is a phone.
BOT_TOKEN = r"\b(\d{8,11}):AA[A-Za-z0-9_-]{30,40}\b"
APP_TELEGRAM = r"(?i)(?:t\.me|telegram\.me)/([A-Za-z0-9_]{5,32})"
APP_URL = r"(?i)https?://[A-Za-z0-9.-]+(?::\d+)?(?:/[^\s\"'<>]*)?"
PHONE_STRING = r"(?i)^\s*(?:tel:|https?://wa\.me/)?(?:\+?91[\s-]?)?[6-9]\d{9}\s*$"
PHONE_CONTEXT = r"(?i)\b(call|whatsapp|contact|helpline|customer care|sms to|number)\b"
# Endings of file names that look like domains.
FILE_ENDINGS = "apk pdf jpg jpeg png gif txt doc docx xls xlsx zip exe html htm php js json xml csv mp4 mp3".split()
# First lines of reports by recipient, heading of what matters to it, and types of entities that do.
INTROS = {
    "registrar": "Please suspend the domains listed below, which impersonate a payment brand to defraud users.",
    "hosting": "Please disable hosting for the sites listed below, which are phishing pages for UPI/payment fraud.",
    "bank": "The sites below impersonate your brand. Please initiate takedown and block the linked payment handles.",
    "npci": "Please review and block the UPI handles listed below, which collect payments through fraudulent pages.",
    "cert_in": "Reporting a coordinated phishing campaign impersonating Indian payment brands.",
    "safe_browsing": "Please add the URLs below to the phishing blocklist.",
    "app_store": "Please remove the Android applications below and flag them in Google Play Protect. They impersonate payment brands to steal UPI credentials and OTPs.",
    "cybercrime_portal": "Complaint regarding an organised online financial fraud campaign that impersonates Indian payment brands through the websites, apps and payment handles listed below.",
    "telecom": "The phone numbers below are advertised on fraudulent payment pages as contact numbers. Please investigate and disconnect them.",
}
CONTEXTS = {
    "registrar": ("Registrar / domain context", ["registrar"]), "hosting": ("Hosting / network context", ["ip", "asn", "cert_fingerprint"]), "bank": ("Payment handle context", ["upi_id", "phone"]),
    "npci": ("UPI handle context", ["upi_id", "phone"]), "cert_in": ("Infrastructure context", ["ip", "asn", "registrar", "upi_id", "phone"]), "safe_browsing": ("URLs to blocklist", []),
    "app_store": ("Application context", ["signing_cert", "package_name", "domain"]), "cybercrime_portal": ("Payment and contact identifiers", ["upi_id", "phone", "telegram", "ip"]), "telecom": ("Fraud phone numbers", ["phone"]),
}
WANTS_DOMAINS = ["registrar", "cert_in", "cybercrime_portal"]
# Headings and other words of reports.
EVIDENCE, NO_EVIDENCE, NO_CONTEXT, NO_APPS, REPORTED, CLOSING = "Evidence linking these sites:", "  - (none recorded)", "  - (none available)", "  - (no Android applications in this campaign)", "Reported URLs:", "Generated automatically; analyst-reviewed before sending."
# Why a plan has an item, in the order of plans, and what is added where no contact is known; {} is the item's name.
RATIONALES = {
    "registrar": "Suspend the domain registrations held at {}",
    "hosting": "Remove the content hosted on {}",
    "bank": "Notify {} so it can warn customers and pursue its own takedowns",
    "npci": "Freeze the UPI handles collecting victims' payments",
    "telecom": "Report fraud phone numbers via Sanchar Saathi (Chakshu)",
    "app_store": "Block the fake apps through Google Play Protect",
    "safe_browsing": "Warn browser users while takedowns are pending",
    "cert_in": "Report the coordinated campaign to CERT-In",
    "cybercrime_portal": "File with the National Cyber Crime Reporting Portal",
}
NO_CONTACT = {"registrar": " (no RDAP abuse contact on record; run enrichment)", "bank": " (no published phishing-report address verified)"}

KEYWORDS = [(k, key) for key, _, keywords, _, _ in BRANDS for k in keywords]
OFFICIAL = [(d, key) for key, _, _, domains, _ in BRANDS for d in domains]

# Generic top-level domains in common use; two letters are a country's. A full list of public suffixes is a parameter of what asks for one.
GENERIC_SUFFIXES = """com org net edu gov mil int info biz name pro mobi aero coop museum jobs travel tel cat asia post arpa
app dev page web cloud digital network systems email media news blog agency company solutions services group team global world
money finance financial bank sbi insurance credit cards cash fund investments trading capital market markets exchange business
tech technology software computer codes tools academy school university education training health care clinic dental
shopping sale deals gift gifts promo discount delivery express direct center zone city land house homes property estate
social chat video photos photo pictures audio music games game play fun fan club community foundation charity
art design studio fashion shoes clothing food restaurant cafe bar pizza recipes tours hotel flights
press online site website xyz top icu shop store live life work today win vip one run fit""".split()
