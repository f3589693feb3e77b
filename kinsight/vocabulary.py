"""Fixed values shared by the operators."""

# The domain's vocabularies, in their usual order.
DEVICE_TYPES = ["tv", "desktop", "mobile", "tablet"]
GENRES = ["Drama", "Comedy", "Action", "Documentary", "Kids", "Animation", "Reality", "Thriller", "Romance", "SciFi"]
CHANNELS = ["Email", "Search", "Display", "Social", "TV", "Direct"]
EVENT_TYPES = ["play", "pause", "browse", "search", "click", "conversion", "impression", "ad_click"]
KIDS_GENRES = ["Animation", "Kids", "Family"]
TEEN_GENRES = ["Action", "SciFi", "Fantasy", "Animation", "Comedy"]
# The age bracket by content counts a shorter list of teen genres.
BRACKET_TEEN_GENRES = ["Action", "SciFi", "Fantasy", "Animation"]
ADULT_GENRES = ["Drama", "Documentary", "Thriller", "Romance"]

# Population priors by persona: probability, peak hours, genres, devices.
PERSONA_PRIORS = {
    "primary_adult": (0.4, [20, 21, 22, 23, 19], ["Drama", "Documentary", "Thriller"], ["tv", "desktop"]),
    "secondary_adult": (0.25, [18, 19, 20, 21, 14], ["Comedy", "Reality", "Romance"], ["tv", "tablet"]),
    "teen": (0.20, [21, 22, 23, 0, 1], ["Action", "SciFi", "Comedy"], ["mobile", "tablet"]),
    "child": (0.15, [15, 16, 17, 10, 11], ["Animation", "Kids", "Family"], ["tablet", "tv"]),
}
# Base intent and price sensitivity by persona (0.5 for any other).
BASE_INTENT = {"primary_adult": 0.7, "secondary_adult": 0.6, "teen": 0.4, "child": 0.2}
PRICE_SENSITIVITY = {"primary_adult": 0.3, "secondary_adult": 0.4, "teen": 0.6, "child": 0.2}
# Segment templates: personas (None: any), least intent, device, channel efficacy, frequency, return multiplier.
SEGMENTS = {
    "high_intent_desktop_adult": (["primary_adult", "secondary_adult"], 0.7, "desktop", {"Email": 0.8, "Search": 0.7, "Display": 0.4}, 3, 1.5),
    "low_intent_mobile_teen": (["teen"], 0.3, "mobile", {"Social": 0.6, "Display": 0.3, "Video": 0.5}, 5, 1.2),
    "family_co_viewing": (None, 0.5, "tv", {"TV": 0.9, "Display": 0.2, "Social": 0.1}, 2, 1.8),
    "price_sensitive_bargain_hunter": (None, 0.4, "mobile", {"Email": 0.7, "Search": 0.6, "Display": 0.3}, 4, 1.3),
}
