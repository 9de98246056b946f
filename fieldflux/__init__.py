"""Parcel evapotranspiration and irrigation analytics as Spark DataFrame operators."""
