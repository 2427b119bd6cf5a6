"""Table schemas, and the column-name mapping for files that use the source's names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _L, _B, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()

ARRIVAL_ADVICE = _struct(minutes_ahead=_L, reason=_S)
WEATHER = _struct(temp_max=_D, temp_min=_D, rain_mm=_D, weather_code=_L, description=_S, wind_max_kmh=_D)
RESTAURANT = _struct(name=_S, rating=_D, price=_S, address=_S, distance_m=_L)
LODGING = _struct(name=_S, kind=_S, rating=_D, price=_S, address=_S, distance_m=_L)

# Catalogue documents as the events API returns them (only the fields that are used).
_NAMED = _struct(name=_S)
_IMAGES = T.ArrayType(_struct(ratio=_S, width=_L, url=_S))
_VENUE = _struct(
    id=_S, name=_S, city=_NAMED, address=_struct(line1=_S), postalCode=_S,
    location=_struct(latitude=_S, longitude=_S),
)
RAW_EVENT = T.StructType([
    T.StructField("id", _S), T.StructField("name", _S), T.StructField("url", _S), T.StructField("test", _B),
    T.StructField("dates", _struct(
        start=_struct(localDate=_S, localTime=_S, dateTime=_S), status=_struct(code=_S))),
    T.StructField("sales", _struct(public=_struct(startDateTime=_S, endDateTime=_S))),
    T.StructField("classifications", T.ArrayType(_struct(segment=_NAMED, genre=_NAMED, subGenre=_NAMED))),
    T.StructField("_embedded", _struct(
        venues=T.ArrayType(_VENUE), attractions=T.ArrayType(_struct(id=_S, name=_S, images=_IMAGES)))),
    T.StructField("images", _IMAGES),
    T.StructField("promoter", _NAMED),
    T.StructField("description", _S),
])
RAW_PAGE = T.StructType([
    T.StructField("_embedded", T.StructType([T.StructField("events", T.ArrayType(RAW_EVENT))])),
    T.StructField("page", _struct(number=_L, totalPages=_L, totalElements=_L)),
])

# Places as the nearby-places API returns them.
RAW_PLACE = T.StructType([
    T.StructField("displayName", _struct(text=_S)),
    T.StructField("location", _struct(latitude=_D, longitude=_D)),
    T.StructField("rating", _D), T.StructField("priceLevel", _S),
    T.StructField("formattedAddress", _S), T.StructField("types", T.ArrayType(_S)),
])

SEMANTIC_FIELDS = _struct(
    mood=_S, occasion_tags=T.ArrayType(_S), price_band=_S, setting=_S, time_slot=_S,
    romantic_score=_L, family_score=_L, group_score=_L, tourist_score=_L,
    duration_minutes=_L, plan_pairings=T.ArrayType(_S), category=_S, subcategory=_S,
)

# The 38 columns of the catalogue warehouse table.
WAREHOUSE = T.StructType([
    T.StructField("id", _S, False), T.StructField("name", _S), T.StructField("url", _S),
    T.StructField("event_date", T.DateType()), T.StructField("event_time", _S), T.StructField("starts_at", _TS),
    T.StructField("status", _S), T.StructField("sale_start", _TS), T.StructField("sale_end", _TS),
    T.StructField("segment", _S), T.StructField("genre", _S), T.StructField("subgenre", _S),
    T.StructField("venue_id", _S), T.StructField("venue_name", _S), T.StructField("city", _S),
    T.StructField("address", _S), T.StructField("postal_code", _S),
    T.StructField("latitude", _D), T.StructField("longitude", _D),
    T.StructField("artist_id", _S), T.StructField("artist_name", _S),
    T.StructField("promoter", _S), T.StructField("description", _S),
    T.StructField("arrival_advice", ARRIVAL_ADVICE),
    *SEMANTIC_FIELDS.fields,
    T.StructField("weather", WEATHER),
])

ENVELOPE = T.StructType([
    T.StructField("subscription_name", _S), T.StructField("message_id", _S),
    T.StructField("publish_time", _TS), T.StructField("data", _S), T.StructField("attributes", _S),
])

# The 18 columns of the interaction fact; the interaction CSV has the same ones.
FACT = _struct(
    interaction_id=_S, event_timestamp=_TS, user_id=_S, session_id=_S, event_id=_S, interaction_type=_S,
    swipe_direction=_S, liked=_B, recommendation_context=_S, segment=_S, genre=_S, subgenre=_S, city=_S,
    price_min=_D, price_max=_D, event_date=T.DateType(), venue_id=_S, ingestion_timestamp=_TS,
)

USERS = _struct(
    id=_S, auth_uid=_S, email=_S, username=_S, full_name=_S, avatar_url=_S, is_active=_B, is_verified=_B,
    preferred_budget=_S, preferred_location=_S, preferred_location_lat=_D, preferred_location_lng=_D,
    preferred_categories=T.ArrayType(_S), created_at=_TS, updated_at=_TS,
)
SAVED_EVENTS = _struct(
    id=_S, user_id=_S, event_id=_S, event_title=_S, event_venue=_S, event_date=_S, event_time=_S,
    event_image_url=_S, event_url=_S, created_at=_TS,
)

# Column names in existing files, and the names used here.
SOURCE_NAMES = {
    "nombre": "name", "fecha": "event_date", "hora": "event_time", "fecha_utc": "starts_at",
    "estado": "status", "venta_inicio": "sale_start", "venta_fin": "sale_end",
    "segmento": "segment", "genero": "genre", "subgenero": "subgenre",
    "recinto_id": "venue_id", "recinto_nombre": "venue_name", "ciudad": "city",
    "direccion": "address", "codigo_postal": "postal_code", "latitud": "latitude", "longitud": "longitude",
    "artista_id": "artist_id", "artista_nombre": "artist_name", "artista_imagen": "artist_image",
    "imagen_evento": "event_image", "promotor": "promoter", "descripcion": "description",
    "precio_min": "price_min", "precio_max": "price_max", "fecha_evento": "event_date",
}


def with_english_names(df: DataFrame) -> DataFrame:
    """Rename columns that carry the source's names; other columns are kept."""
    return df.withColumnsRenamed({old: new for old, new in SOURCE_NAMES.items() if old in df.columns})
