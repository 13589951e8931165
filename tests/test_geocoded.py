from evidentia.sources.geocoded import geocode, reverse_geocode, unasked

PLACES = "k long, locality string, district string, pin string, geo_by string"
ANSWERS = "query string, lat double, lon double, seq long"
ADDRESSES = "lat double, lon double, seq long, suburb string, neighbourhood string, quarter string, village string, city string, town string, state_district string, county string"


def test_first_answer_in_the_region_wins(spark):
    places = spark.createDataFrame(
        [(1, "Kokapet", "Ranga", "500075", "x"), (2, "Kokapet", " ", None, "x"), (3, None, "Ranga", "500075", None), (4, None, None, None, None), (4, None, None, None, None), (5, "Tellapur", None, "1", None)], PLACES
    )
    answers = spark.createDataFrame(
        [
            ("Kokapet, Ranga, Telangana, India", 19.0, 78.3, 1),  # beyond the region
            ("Kokapet, Hyderabad, Telangana, India", 10.0, 10.0, 1),
            ("Kokapet, Hyderabad, Telangana, India", 17.4, 78.3, 2),  # asked anew
            ("500075, India", 17.0, 78.0, 1),
            ("Tellapur, Hyderabad, Telangana, India", None, None, 1),
        ],
        ANSWERS,
    )
    found = geocode(places, answers)
    assert found.columns == ["k", "locality", "district", "pin", "geo_lat", "geo_lon", "geo_by"]
    hits = sorted((r.k, r.geo_lat, r.geo_by) for r in found.where("geo_by is not null").collect())
    assert hits == [(1, 17.4, "locality"), (2, 17.4, "locality"), (3, 17.0, "PIN code")]
    assert found.count() == 6
    assert [r.query for r in unasked(places, answers).collect()] == ["1, India"]
    none = answers.where("false")
    assert sorted(r.query for r in unasked(places, none).collect()) == ["500075, India", "Kokapet, Hyderabad, Telangana, India", "Kokapet, Ranga, Telangana, India", "Tellapur, Hyderabad, Telangana, India"]
    assert geocode(places.where("false"), answers).count() == 0


def test_coordinates_name_blank_rows_only(spark):
    rows = spark.createDataFrame([(1, "17.44001", "78.3", None, ""), (2, "17.44", "78.3", "Own", None), (3, "north", None, "", ""), (4, "1", "1", None, None)], "k long, lat string, lon string, locality string, city string")
    named = [(17.44, 78.3, 1, "Old", "", "", "", "Old", "", "", ""), (17.44, 78.3, 2, "", None, "", "Kokapet", None, "", "Mumbai Suburban District", "")]
    out = reverse_geocode(rows, spark.createDataFrame(named, ADDRESSES))
    assert out.columns == rows.columns
    assert sorted((r.k, r.locality, r.city) for r in out.collect()) == [(1, "Kokapet", "Mumbai"), (2, "Own", ""), (3, "", ""), (4, "", "")]
