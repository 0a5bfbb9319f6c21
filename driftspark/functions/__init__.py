"""driftspark.functions"""
