"""driftspark.streaming"""
