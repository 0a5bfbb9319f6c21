"""driftspark.operators"""
