"""A geospatial analytics engine whose operators are lazy DataFrame functions."""
