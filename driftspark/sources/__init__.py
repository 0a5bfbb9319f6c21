"""driftspark.sources"""
