from pyspark.sql import functions as F

from quarrion.llm.entities import SURE, matched


def test_element_of_the_fourth_nearest_place(spark):
    """A map element without postcode meets a record of a place that is not among its nearest three, by phone or by stated city."""
    zips = spark.createDataFrame([(f"7000{i}", 30.0 + i / 20, -95.0, c, "TX") for i, c in enumerate(("Ivesholm", "Dunton", "Carside", "Wickbrook"))], "zip string, lat double, lng double, city string, state string")
    cols = "id long, name string, address string, city string, state string, zip string, phone string, website string"
    tx = spark.createDataFrame([(1, "Tarby Eastern Cars", "12 Oak St", "Wickbrook", "TX", "70003", "(292) 555-1234", "tarby.test"), (2, "Halmock Pioneer", "9 Elm St", "Wickbrook", "TX", "70003", None, None)], cols)
    tags = [{"name": "tarby eastern cars", "phone": "292-555-1234"}, {"name": "Halmock Pioneer", "addr:city": "Wickbrook"}, {"name": "Halmock Pioneer"}]
    osm = spark.createDataFrame([(9 + i, 30.0, -95.0, None, t) for i, t in enumerate(tags)], "id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = {(r.key_a, r.key_b) for r in matched({"tx_directory": tx.withColumn("x", F.lit(1))}, osm, zips).where(F.col("confidence") >= SURE).collect()}
    assert got == {("osm_sample:9", "tx_directory:1"), ("osm_sample:10", "tx_directory:2")}


def test_names_are_searched_in_all_places(spark):
    """Beyond the nearest three places a name meets as well: found beside a page of the same site or an address misspelt beyond the radius, a candidate that is not sure by itself."""
    zips = spark.createDataFrame([(f"7000{i}", 30.0 + i / 20, -95.0, c, "TX") for i, c in enumerate(("Ivesholm", "Dunton", "Carside", "Wickbrook", "Selvick"))], "zip string, lat double, lng double, city string, state string")
    cols = "id long, name string, address string, city string, state string, zip string, phone string, website string"
    tx = [(1, "Tarby Eastern Cars", None, "Wickbrook", "TX", "70003", None, "tarby.test/wickbrook"), (2, "Halmock Pioneer", None, "Selvick", "TX", "70004", None, None), (3, "Quarnby Ostler", "1200 Winfreystead St", "Selvick", "TX", "70004", None, None)]
    tags = [{"name": "tarby eastern cars", "website": "tarby.test"}, {"name": "Halmock Pioneer"}, {"name": "Quarnby Ostler", "addr:housenumber": "1200", "addr:street": "Wibfreyxteaq St"}]
    osm = spark.createDataFrame([(9 + i, 30.0, -95.0, None, t) for i, t in enumerate(tags)], "id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = {(r.key_a, r.key_b): r.confidence for r in matched({"tx_directory": spark.createDataFrame(tx, cols)}, osm, zips).collect()}
    assert set(got) == {("osm_sample:9", "tx_directory:1"), ("osm_sample:10", "tx_directory:2"), ("osm_sample:11", "tx_directory:3")}
    assert {k for k, c in got.items() if c >= SURE} == set(got) - {("osm_sample:10", "tx_directory:2")}


def test_stated_city_of_two_states(spark):
    """A city stated without its state is each near place of that name, not the nearest alone."""
    zips = spark.createDataFrame([("70001", 30.0, -95.0, "Harlholm", "TX"), ("71001", 30.1, -95.0, "Harlholm", "AR")], "zip string, lat double, lng double, city string, state string")
    cols = "id long, name string, address string, city string, state string, zip string, phone string, website string"
    tx = spark.createDataFrame([(1, "Tarby Eastern Cars", None, "Harlholm", "AR", "71001", None, None)], cols)
    osm = spark.createDataFrame([(9, 30.0, -95.0, None, {"name": "Tarby Eastern Cars", "addr:city": "Harlholm"})], "id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = {(r.key_a, r.key_b) for r in matched({"tx_directory": tx}, osm, zips).where(F.col("confidence") >= SURE).collect()}
    assert got == {("osm_sample:9", "tx_directory:1")}
