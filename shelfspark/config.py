"""Policy and the fixed vocabulary of the catalog: plain values, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    base_currency: str = "EGP"
    usd_rate: float = 48.5
    margin_target: float = 54.0
    margin_warn: float = 25.0
    margin_critical: float = 10.0
    margin_implausible: float = 900.0
    min_quality: float = 70.0
    similar: float = 0.86
    header_similar: float = 0.7
    header_depth: int = 20
    header_min_mapped: int = 2
    image_link: float = 0.55
    audit_tail: int = 100

    def __post_init__(self):
        if not 0 <= self.margin_critical <= self.margin_warn <= self.margin_target:
            raise ValueError("margins must rise from critical over warn to target")
        if self.usd_rate <= 0:
            raise ValueError("the exchange rate must be positive")


POLICY = Policy()

# Fixed values that results depend on.

#: Code: severity, penalty.
ISSUES = {
    "MISSING_NAME": ("critical", 25), "DUPLICATE_SKU": ("critical", 25), "MISSING_COST": ("critical", 10), "MISSING_SELLING_PRICE": ("critical", 10),
    "NEGATIVE_PRICE": ("critical", 25), "SELLING_BELOW_COST": ("critical", 25), "MARKET_BELOW_COST": ("critical", 20), "CRITICAL_MARGIN": ("critical", 18),
    "MISSING_SKU": ("high", 0), "AMBIGUOUS_SKU": ("high", 15), "DUPLICATE_PRODUCT": ("high", 15), "MISSING_CURRENCY": ("high", 5), "LOW_MARGIN": ("high", 10),
    "IMPLAUSIBLE_MARGIN": ("high", 12), "RRP_BELOW_COST": ("high", 15), "COST_MISMATCH": ("high", 12), "SOURCE_CONFLICT": ("high", 8),
    "MISSING_BRAND": ("medium", 0), "MISSING_CATEGORY": ("medium", 0), "ESTIMATED_PRICE": ("medium", 8), "PRICE_RANGE_ONLY": ("medium", 8),
    "MISSING_SUPPLIER": ("medium", 0), "GENERIC_ITEM": ("medium", 10), "DRAFT_ITEM": ("medium", 10), "INCOMPLETE_SOURCE_DATA": ("medium", 0),
    "GENERATED_SKU": ("low", 4), "UNMAPPED_CATEGORY": ("low", 4), "MISSING_SPECS": ("low", 0), "MISSING_QUANTITY": ("low", 0), "MISSING_IMAGES": ("low", 0),
    "SKU_CORRECTED": ("info", 0), "UNPARSED_COLUMNS": ("info", 0),
}
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Group: field, weight; 100 in all.
COMPLETENESS = {
    "identity": {"name": 12, "brand": 8, "sku": 10, "category": 5},
    "pricing": {"currency": 5, "rdp": 11, "selling_price": 11, "market": 5},
    "specs": {"any_spec": 8, "condition": 3, "description": 4},
    "commercial": {"supplier": 6, "quantity": 4},
    "media": {"images": 8},
}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
BANDS = ("loss", "critical", "low", "healthy", "target", "implausible", "unknown")
NULL_TOKENS = ("", "-", "--", "n/a", "na", "n.a.", "none", "null", "nil", "tbd", "tba", "not purchased", "unknown", "unpriced", "?", "x", "لا يوجد", "غير متاح")

BRAND_ALIASES = {
    "anker": "Anker", "anker eufy line": "eufy", "anker eufy": "eufy", "eufy": "eufy", "soundcore": "Soundcore", "soundcore by anker": "Soundcore",
    "anker soundcore": "Soundcore", "soundcore anker": "Soundcore", "joyroom": "Joyroom", "kingston": "Kingston", "hikvision": "Hikvision",
    "lexar": "Lexar", "sandisk": "SanDisk", "crucial": "Crucial", "western digital": "Western Digital", "wd": "Western Digital", "pny": "PNY",
    "dell": "Dell", "hp": "HP", "lenovo": "Lenovo", "logitech": "Logitech", "havit": "Havit", "airlive": "AirLive", "wild wolf": "Wild Wolf",
    "baseus": "Baseus", "ugreen": "UGREEN",
}
GENERIC_BRANDS = ("generic", "generics", "no brand", "nobrand", "unbranded", "oem", "unknown", "n a", "na", "none", "various", "mixed", "assorted", "other", "tbd")
BRAND_PARENTS = {"Soundcore": "Anker", "eufy": "Anker"}
CATEGORY_CODES = {
    "Cables": "CBL", "Chargers": "CHG", "Power Banks": "PWB", "Audio": "AUD", "Storage": "STO", "Memory": "MEM", "Input Devices": "INP",
    "Networking": "NET", "Hubs & Adapters": "HUB", "Accessories": "ACC", "Smart Home": "SMH", "Wearables": "WER",
}
#: Category: terms, and subcategories with their terms. The first of equal scores and the first matching subcategory win.
TAXONOMY = {
    "Cables": (
        ("cable", "cables", "كابل", "كابلات", "wire", "cord"),
        {
            "Display Cables": ("hdmi", "vga", "displayport", "display port", "dp to dp", "display cable", "monitor cable", "dvi"),
            "Internal PC Cables": ("sata", "internal pc cable", "power laptop", "molex"),
            "Charging Cables": ("type-c", "type c", "usb-c", "usb c", "lightning", "micro usb", "charging cable", "data cable", "c-c", "c-l", "powerline", "iphone"),
            "Multi-Head Cables": ("3-in-1", "6-in-1", "3 in 1", "6 in 1", "multi"),
        },
    ),
    "Chargers": (
        ("charger", "chargers", "شاحن", "شواحن", "charging", "adapter power", "wall charger"),
        {
            "Wall Chargers": ("wall", "gan", "pd", "cube", "powerport", "جداري"),
            "Car Chargers": ("car", "vehicle", "سيارة"),
            "Wireless Chargers": ("wireless", "magsafe", "qi", "magnetic"),
        },
    ),
    "Power Banks": (
        ("power bank", "powerbank", "باور بانك", "بور بانك", "portable charger", "power banks"),
        {
            "Magnetic Power Banks": ("magnetic", "magsafe", "maggo"),
            "Retractable Power Banks": ("retractable", "built-in cable"),
            "High Capacity": ("20k", "30k", "20000", "30000", "25000"),
        },
    ),
    "Audio": (
        ("earbud", "earbuds", "earphone", "earphones", "audio", "سماعات", "سماعة", "headphone", "headphones", "speaker", "speakers", "tws", "soundcore"),
        {
            "Headphones": ("over-ear", "over ear", "headphone", "headset"),
            "True Wireless Earbuds": ("tws", "true wireless", "earbud", "anc"),
            "Wired Earphones": ("wired", "earphone"),
            "Speakers": ("speaker", "boombox", "glow"),
        },
    ),
    "Storage": (
        ("ssd", "storage", "flash", "flash memory", "usb flash", "hard disk", "hdd", "memory card", "قرص", "فلاش"),
        {
            "NVMe SSD": ("nvme", "m.2", "m2 ssd"),
            "SATA SSD": ("sata ssd", "internal ssd", "2.5", "bx500", "a400", "sa510", "cs900"),
            "USB Flash Drives": ("flash drive", "usb flash", "jumpdrive", "datatraveler", "cruzer", "thumb drive"),
            "Memory Cards": ("sd card", "microsd", "micro sd"),
        },
    ),
    "Memory": (
        ("ram", "memory", "ذاكرة", "ddr", "sodimm", "dimm"),
        {"Laptop RAM": ("sodimm", "laptop", "ddr3l", "so-dimm"), "Desktop RAM": ("desktop", "dimm", "udimm")},
    ),
    "Input Devices": (
        ("keyboard", "keyboards", "mouse", "mice", "mousepad", "mouse pad", "input device", "لوحة مفاتيح", "ماوس"),
        {"Mouse Pads": ("mousepad", "mouse pad", "pad"), "Keyboards": ("keyboard", "لوحة مفاتيح"), "Mice": ("mouse", "mice", "ماوس")},
    ),
    "Networking": (
        ("wi-fi", "wifi", "network", "router", "ethernet", "lan", "airlive", "شبكة"),
        {"Wi-Fi Adapters": ("usb adapter", "wifi usb", "wi-fi usb", "dongle"), "Routers": ("router", "access point")},
    ),
    "Hubs & Adapters": (
        ("hub", "dock", "adapter", "adapters", "otg", "converter", "converts", "محول", "موزع"),
        {"USB-C Hubs": ("usb-c hub", "type-c hub", "docking"), "OTG Adapters": ("otg", "usb-otg"), "Video Converters": ("hdmi to vga", "vga to hdmi", "converter")},
    ),
    "Accessories": (
        ("accessor", "إكسسوارات", "اكسسوارات", "holder", "case", "screen protector", "stand", "mount", "stylus"),
        {
            "Phone Holders": ("holder", "mount", "حامل"),
            "Screen Protectors": ("screen protector", "tempered", "واقي شاشة"),
            "Cases": ("case", "cover", "جراب"),
            "Styluses": ("stylus",),
        },
    ),
    "Smart Home": (("robovac", "vacuum", "eufy", "smart home", "camera", "كاميرا"), {"Robot Vacuums": ("robovac", "vacuum"), "Trackers": ("smarttrack", "tracker")}),
    "Wearables": (("smartwatch", "watch", "band", "ساعة"), {"Smartwatches": ("smartwatch", "watch")}),
}
FOLDER_HINTS = {
    "Cables": ("Cables", None), "Chargers": ("Chargers", None), "Power Banks": ("Power Banks", None), "Cable": ("Cables", None), "Charger": ("Chargers", None),
    "Converts": ("Hubs & Adapters", None), "Earbuds": ("Audio", "True Wireless Earbuds"), "Flash Memory": ("Storage", "USB Flash Drives"),
    "Keyboard": ("Input Devices", "Keyboards"), "Mouse": ("Input Devices", "Mice"), "MousePad": ("Input Devices", "Mouse Pads"),
    "Power Bank": ("Power Banks", None), "RAM": ("Memory", None), "SSD": ("Storage", "SATA SSD"), "Wireless": ("Networking", None),
}
COLORS = ("black", "white", "blue", "navy blue", "space gray", "space grey", "grey", "gray", "silver", "gold", "pink", "red", "green", "yellow", "teal", "purple", "orange")
GENERIC_WORDS = ("general", "generic", "assorted", "various", "misc", "miscellaneous", "placeholder", "sample", "example", "unassigned", "tbd", "tba", "unknown", "any", "standard type")
DRAFT_WORDS = ("draft", "مسودة", "coming soon", "قريبا", "قريباً", "not started", "wip")
TOTAL_WORDS = ("total", "totals", "grand total", "subtotal", "sum", "الإجمالي", "المجموع", "اجمالي")
NOTE_PREFIXES = ("note:", "notes:", "source:", "legend:", "disclaimer:", "ملاحظة:")
RESERVED_CODES = ("RDP", "RRP", "USD", "EGP", "USB", "HDMI", "VGA", "SATA", "ANC", "OTG")
#: Sheet name pattern: procurement verdict, or why it holds no products.
SHEET_PROCUREMENT = (("must\\s*buy", "must_buy"), ("test\\s*buy", "test_buy"), ("avoid", "avoid"), ("opportunit", "opportunity"))
SHEET_SKIPPED = (
    ("^overview$", "prose_sheet"), ("negotiation|kpi", "prose_sheet"), ("^summary(?![A-Za-z0-9_])|summary by|investment summary", "rollup_sheet"),
    ("roadmap|data model|executive summary", "planning_sheet"), ("corrections?\\s*(log)?$", "audit_log_sheet"), ("solutions|services|build\\s*blockers", "not_a_product_entity"),
)
#: Field, specificity, aliases, patterns.
HEADERS = (
    ("row_number", 1, ("#", "no", "no.", "num", "index", "s/n", "serial", "م"), ()),
    ("name", 5, ("product", "product name", "name", "item", "item name", "title", "description", "product title", "model name", "draft product", "المنتج", "اسم المنتج", "الصنف"), (r"^product(\s*name)?$", r"^item(\s*name)?$")),
    ("brand", 5, ("brand", "manufacturer", "make", "vendor brand", "الماركة", "العلامة التجارية"), ()),
    ("sku", 6, ("sku", "model", "model / sku", "model/sku", "model no", "model number", "part number", "mpn", "product code", "code", "item code", "كود المنتج", "الموديل"), (r"\bsku\b", r"^model\b", r"\bpart\s*(no|number)\b")),
    ("supplier_sku", 8, ("supplier / sku", "supplier/sku", "supplier sku", "vendor / sku", "brand / sku"), ()),
    ("supplier", 5, ("supplier", "vendor", "distributor", "source supplier", "المورد"), ()),
    ("category", 5, ("category", "product category", "type", "group", "الفئة", "التصنيف", "القسم"), ()),
    ("subcategory", 6, ("subcategory", "sub category", "sub-category", "secondary category"), ()),
    ("rdp", 9, ("rdp (verified, egp)", "verified rdp (egp)", "verified rdp", "rdp verified", "rdp (verified)", "actual rdp", "confirmed cost"), (r"rdp.*verified", r"verified.*rdp")),
    ("rdp", 4, ("rdp", "cost", "wholesale", "wholesale price", "dealer price", "buy price", "purchase price", "cost price", "unit cost", "سعر الجملة", "التكلفة"), (r"^rdp\b", r"\bwholesale\b", r"\bdealer\s*price\b")),
    ("rdp_reported", 9, ("rdp (plan, egp)", "rdp plan", "plan rdp", "rdp (plan)", "claimed rdp"), (r"rdp.*plan", r"plan.*rdp")),
    ("rrp", 9, ("rrp (verified, egp)", "verified rrp (egp)", "verified rrp", "rrp verified", "rrp (verified)"), (r"rrp.*verified", r"verified.*rrp")),
    ("rrp", 4, ("rrp", "msrp", "retail price", "recommended retail", "list price", "سعر البيع المقترح", "سعر القائمة"), (r"^rrp\b", r"\bmsrp\b", r"recommended\s*retail")),
    ("rrp_reported", 9, ("rrp (plan, egp)", "rrp plan", "plan rrp", "rrp (plan)"), (r"rrp.*plan",)),
    ("selling_price", 6, ("selling price", "sale price", "sell price", "our price", "price", "est. price (usd)", "est. price (egp)", "est price", "estimated price", "price (usd)", "price (egp)", "unit price", "السعر", "سعر البيع"), (r"^est\.?\s*price", r"^price\b", r"selling\s*price")),
    ("market_price", 7, ("local market (egp)", "local market", "market price", "street price", "competitor price", "market range", "سعر السوق"), (r"local\s*market", r"market\s*(price|range)", r"street\s*price")),
    ("margin_reported", 6, ("margin", "margin %", "margin % (rrp basis)", "margin percent", "gross margin", "profit margin", "هامش الربح"), (r"\bmargin\b",)),
    ("currency", 6, ("currency", "ccy", "العملة"), ()),
    ("extended_cost", 8, ("est. cost (egp, formula)", "est. cost", "estimated cost", "total cost", "line total", "extended cost", "التكلفة الإجمالية"), (r"est\.?\s*cost", r"total\s*cost", r"line\s*total")),
    ("quantity", 5, ("qty", "quantity", "stock", "stock qty", "units", "on hand", "الكمية"), (r"^qty\b", r"^quantity\b", r"\bstock\b")),
    ("warehouse", 5, ("warehouse", "location", "store"), ()),
    ("specs_raw", 6, ("key specifications", "specifications", "specs", "key specs", "technical specs", "key features", "features", "المواصفات", "المميزات"), (r"\bspecs?\b", r"specifications", r"key\s*features")),
    ("capacity", 6, ("capacity", "capacity / speed / variants", "size", "storage", "variants", "capacity/speed", "السعة"), (r"\bcapacity\b",)),
    ("interface", 6, ("interface", "connection", "connector", "port", "المنفذ"), ()),
    ("form_factor", 6, ("form factor", "formfactor", "format"), ()),
    ("compatibility", 6, ("compatibility", "compatible with", "works with", "التوافق", "يتوافق مع"), (r"compatib",)),
    ("condition", 6, ("condition", "state", "grade", "الحالة"), ()),
    ("warranty", 6, ("warranty", "warranty months", "guarantee", "الضمان"), ()),
    ("color", 5, ("color", "colour", "colors", "اللون"), ()),
    ("short_description", 7, ("short description", "summary", "tagline", "وصف مختصر"), ()),
    ("long_description", 7, ("full description", "long description", "details", "وصف تفصيلي"), ()),
    ("notes", 5, ("notes", "verification notes", "note", "remarks", "comment", "comments", "issue", "missing fields", "ملاحظات"), (r"\bnotes?\b", r"\bremarks?\b")),
    ("action", 7, ("recommended action", "action", "recommendation", "decision", "status", "الإجراء", "التوصية"), (r"recommend", r"^action$")),
    ("source_catalog", 7, ("source catalog", "source", "origin", "source file"), ()),
    ("tags", 5, ("tags", "labels", "keywords"), ()),
)
ANCHORS = ("name", "sku", "supplier_sku", "brand", "category", "rdp", "rrp", "selling_price", "quantity")
MONEY_FIELDS = ("rdp", "rdp_reported", "rrp", "rrp_reported", "selling_price", "market_price", "extended_cost")

# How specifications are written in free text. Of named patterns the first that fits gives the name.
CONNECTORS = (
    ("USB-C", r"type[\s-]?c|usb[\s-]?c|\bc\b"),
    ("USB-A", r"usb[\s-]?a|\busb\s*3\.\d|\busb\s*2\.0|\busb\b"),
    ("Lightning", r"lightning|iphone|\bl\b"),
    ("Micro-USB", r"micro[\s-]?usb|\bmicro\b"),
    ("HDMI", r"hdmi"),
    ("DisplayPort", r"display\s*port|\bdp\b"),
    ("VGA", r"\bvga\b"),
    ("SATA", r"\bsata\b"),
    ("DVI", r"\bdvi\b"),
    ("AUX 3.5mm", r"3\.5\s*mm|\baux\b"),
)
CONNECTOR_LETTERS = {"A": "USB-A", "C": "USB-C", "L": "Lightning"}
DISPLAYS = ("HDMI", "DisplayPort", "VGA", "SATA", "DVI")
CABLE_ENDS = r"([\w.\s-]{1,18}?)\s*(?:to|->|→)\s*([\w.\s-]{1,18})"
CABLE_LETTERS = r"\b([ACL])\s*-\s*([ACL])\b"
INTERFACES = (
    r"usb\s*\d(?:\.\d)?(?:\s*gen\s*\d)?", r"sata\s*(?:i{1,3}|\d)", r"\bnvme\b", r"\bm\.2\b",
    r"pcie\s*\d(?:\.\d)?(?:\s*x\d+)?", r"bluetooth\s*\d(?:\.\d)?", r"wi-?fi\s*\d?", r"ddr\d(?:l)?(?:\s*\d{3,4})?",
)
CONDITIONS = (("original_pull", r"pull|original\s+used"), ("refurbished", r"refurb|renew"), ("used", r"used|مستعمل|second"), ("new", r"new|جديد|sealed"))
WATTS = {"w": 1.0, "watt": 1.0, "watts": 1.0}
GIGABYTES = {"tb": 1024.0, "gb": 1.0, "mb": 1 / 1024}
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "feet": 0.3048, "foot": 0.3048, "in": 0.0254}
YEARS = {"year": 12.0, "yr": 12.0, "yrs": 12.0, "years": 12.0, "سنة": 12.0, "سنوات": 12.0}
MONTHS = {"month": 1.0, "months": 1.0, "شهر": 1.0, "أشهر": 1.0}
#: What tells of a power bank, in a category or a name; how a header says that its prices are estimates.
POWER_BANK = r"(?i)power bank|باور بانك"
ESTIMATE_HEADER = r"\best\.?\b|estimat|approx|~|guess|range"
COLOR_LABEL = r"colou?rs?\s*[:：]\s*([^|,;]+)"
