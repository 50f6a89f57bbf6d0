"""Fixed value pools for identity fields (plain word lists, not taken from any library)."""

FIRST_NAMES = (
    "Ada", "Alan", "Amara", "Anna", "Boris", "Carla", "Chen", "Clara", "David", "Dina",
    "Elena", "Emil", "Farah", "Felix", "Grace", "Hana", "Hugo", "Ines", "Ivan", "Jonas",
    "Kira", "Lars", "Leila", "Lucia", "Marco", "Maya", "Nadia", "Nils", "Olga", "Omar",
    "Paula", "Pedro", "Quinn", "Rosa", "Samir", "Sofia", "Tomas", "Uma", "Viktor", "Yara",
)
LAST_NAMES = (
    "Abbott", "Baker", "Becker", "Costa", "Dubois", "Eriksen", "Fischer", "Garcia", "Haas", "Ito",
    "Jansen", "Kaya", "Kowalski", "Lopez", "Meyer", "Moreau", "Nguyen", "Novak", "Okafor", "Olsen",
    "Patel", "Quist", "Reyes", "Rossi", "Sato", "Silva", "Tanaka", "Urban", "Weber", "Young",
)
MAIL_DOMAINS = ("example.com", "example.net", "example.org")
STREETS = (
    "Alder Lane", "Birch Street", "Canal Road", "Dover Avenue", "Elm Court", "Forest Drive",
    "Garden Way", "Harbor Street", "Hill Road", "Juniper Close", "Lake View", "Maple Avenue",
    "Oak Street", "Park Road", "River Walk", "Station Road",
)
CITIES = (
    "Ashford", "Bridgeport", "Clearwater", "Dunmore", "Eastfield", "Fairview", "Greenville",
    "Hillcrest", "Kingston", "Lakewood", "Milton", "Newbury", "Oakdale", "Riverside",
)
STATES = ("AL", "CA", "CO", "FL", "GA", "IL", "MA", "MI", "NY", "OH", "OR", "PA", "TX", "VA", "WA")
