"""Small fixed lookups. They are literals, so using them needs no join and no broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import clean_label

# Weather code -> text.
WEATHER_CODES = {
    0: "Despejado",
    1: "Principalmente despejado",
    2: "Parcialmente nublado",
    3: "Nublado",
    45: "Niebla",
    48: "Niebla con escarcha",
    51: "Llovizna ligera",
    53: "Llovizna moderada",
    55: "Llovizna densa",
    56: "Llovizna helada ligera",
    57: "Llovizna helada densa",
    61: "Lluvia ligera",
    63: "Lluvia moderada",
    65: "Lluvia fuerte",
    66: "Lluvia helada ligera",
    67: "Lluvia helada intensa",
    71: "Nevada ligera",
    73: "Nevada moderada",
    75: "Nevada intensa",
    77: "Granos de nieve",
    80: "Chubascos ligeros",
    81: "Chubascos moderados",
    82: "Chubascos violentos",
    85: "Chubascos de nieve ligeros",
    86: "Chubascos de nieve intensos",
    95: "Tormenta",
    96: "Tormenta con granizo ligero",
    99: "Tormenta con granizo intenso",
}

# Price level -> symbol.
PRICE_LEVELS = {
    "PRICE_LEVEL_UNSPECIFIED": "No especificado",
    "PRICE_LEVEL_FREE": "Gratis",
    "PRICE_LEVEL_INEXPENSIVE": "€",
    "PRICE_LEVEL_MODERATE": "€€",
    "PRICE_LEVEL_EXPENSIVE": "€€€",
    "PRICE_LEVEL_VERY_EXPENSIVE": "€€€€",
}

# City (lower case, no accents) -> latitude, longitude.
CITY_COORDINATES = {
    "madrid": (40.4168, -3.7038),
    "barcelona": (41.3851, 2.1734),
    "valencia": (39.4699, -0.3763),
    "sevilla": (37.3891, -5.9845),
    "seville": (37.3891, -5.9845),
    "palma de mallorca": (39.5696, 2.6502),
    "mallorca": (39.5696, 2.6502),
    "malaga": (36.7213, -4.4214),
    "bilbao": (43.263, -2.935),
    "zaragoza": (41.6488, -0.8891),
}
DEFAULT_COORDINATES = CITY_COORDINATES["madrid"]

# Lodging kinds in order of preference, and the kind used when none fits.
LODGING_KINDS = ("hotel", "motel", "hostel")
LODGING_DEFAULT = "alojamiento"

# The subcategories allowed under each category.
SUBCATEGORIES = {
    "Música": [
        "Dance/Electrónica", "Flamenco/Rumba", "Hard Rock/Metal", "Hip-Hop/R&B", "Indie/Alternativo",
        "Jazz/Blues", "Latin", "Música Clásica", "Pop/Rock", "Festival",
    ],
    "Arte y Teatro": ["Ballet/Danza", "Circo", "Comedia", "Magia", "Musical", "Ópera"],
    "Deportes": ["Baloncesto", "Ciclismo", "Fútbol", "Motor", "Tenis"],
    "Familia y otros": [
        "Actividades en familia", "Circo", "Espectáculos de Magia", "Parques temáticos", "Teatro infantil",
        "Visitas Guiadas/Exposiciones",
    ],
}

# Allowed words of the semantic attributes.
MOODS = ["romantico", "energetico", "tranquilo", "familiar", "premium", "alternativo"]
OCCASIONS = ["pareja", "amigos", "familia", "solo", "afterwork"]
PRICE_BANDS = ["bajo", "medio", "alto"]
SETTINGS = ["interior", "exterior", "mixto", "desconocido"]
TIME_SLOTS = ["mañana", "tarde", "noche"]


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def lookup_weather_code(code: Column) -> Column:
    return F.try_element_at(_literal_map(WEATHER_CODES), code.cast("int"))


def lookup_price_level(level: Column) -> Column:
    return F.try_element_at(_literal_map(PRICE_LEVELS), level)


def lookup_pin_category(segment: Column) -> Column:
    label = clean_label(segment)
    return (F.when(label == "Music", "music")
            .when(label.isin("Arts & Theatre", "Film"), "art")
            .otherwise("food"))


def place_type(types: Column) -> Column:
    """The first lodging kind, in order of preference, that the place lists."""
    kind = F.lit(None).cast("string")
    for word in reversed(LODGING_KINDS):
        kind = F.when(F.array_contains(types, word), word).otherwise(kind)
    return F.coalesce(kind, F.lit(LODGING_DEFAULT))


def subcategory_allowed(category: Column, subcategory: Column) -> Column:
    """Whether the pair is in the category map; NULL when a side is NULL."""
    allowed = F.create_map(*[
        part for name, words in SUBCATEGORIES.items()
        for part in (F.lit(name), F.array(*[F.lit(word) for word in words]))
    ])
    known = F.try_element_at(allowed, category)
    return F.when(category.isNotNull() & subcategory.isNotNull(),
                  F.coalesce(F.array_contains(known, subcategory), F.lit(False)))


def category_map(spark: SparkSession) -> DataFrame:
    pairs = [(category, word) for category, words in SUBCATEGORIES.items() for word in words]
    return spark.createDataFrame(pairs, "category string, subcategory string")


def city_table(spark: SparkSession) -> DataFrame:
    rows = [(city, lat, lng) for city, (lat, lng) in CITY_COORDINATES.items()]
    return spark.createDataFrame(rows, "city_key string, lat double, lng double")


def enrichment_prompt(name: Column, description: Column, segment: Column, genre: Column, subgenre: Column,
                      venue: Column, time: Column) -> Column:
    """Request text for a semantic-attribute function: the event's seven fields, the allowed answers, the map."""
    answers = {
        "minutes_ahead": "whole number, 15 to 120",
        "reason": "one short sentence in Spanish",
        "mood": "one of " + ", ".join(MOODS),
        "occasion_tags": "1 to 3 of " + ", ".join(OCCASIONS),
        "price_band": "one of " + ", ".join(PRICE_BANDS),
        "setting": "one of " + ", ".join(SETTINGS),
        "time_slot": "one of " + ", ".join(TIME_SLOTS),
        "romantic_score, family_score, group_score, tourist_score": "whole numbers, 0 to 100",
        "duration_minutes": "typical length in minutes",
        "plan_pairings": "1 to 3 snake_case labels",
        "category": "one of " + ", ".join(SUBCATEGORIES),
        "subcategory": "one listed under the chosen category",
    }
    tail = ["Answer with one JSON object:"]
    tail += [f"* {field}: {rule}" for field, rule in answers.items()]
    tail += ["Subcategories by category:"]
    tail += [f"* {category}: {', '.join(words)}" for category, words in SUBCATEGORIES.items()]
    given = {"name": name, "description": description, "segment": segment, "genre": genre,
             "subgenre": subgenre, "venue": venue, "time": time}
    lines = [F.concat(F.lit(f"* {field}: "), F.coalesce(value.cast("string"), F.lit("unknown")))
             for field, value in given.items()]
    return F.concat_ws("\n", F.lit("Classify this event using only these fields:"), *lines, F.lit("\n".join(tail)))
