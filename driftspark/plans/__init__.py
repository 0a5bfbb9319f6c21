"""driftspark.plans"""
